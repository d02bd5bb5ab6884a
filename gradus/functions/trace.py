"""Checks of reasoning texts: gene symbols, keywords with look-back negation, claimed directions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists, stop lists, patterns and weights.
UP = ["upregulat", "up-regulat", "increas", "elevat", "higher", "activat", "induc", "promot", "enhanc", "augment", "amplif", "overexpress", "upexpressed", "positively regulat", "pro-longevity", "extend", "longer lifespan", "lifespan extension", "anti-aging", "anti-senescen"]
DOWN = ["downregulat", "down-regulat", "decreas", "reduc", "lower", "inhibit", "suppress", "diminish", "attenu", "silence", "knockdown", "knock-down", "knockout", "ablat", "deplet", "shorten", "pro-aging", "pro-senescen", "accelerat", "promotes aging", "shortens lifespan"]
NO_CHANGE = ["no significant", "not significant", "unchanged", "no change", "minimal change", "no effect", "no difference", "no alteration", "not altered", "not changed", "not affected"]
SIGNIFICANT = ["significant", "substantial", "robust", "marked", "pronounced", "notably", "considerably", "strongly", "dramatically"]
NOT_SIGNIFICANT = ["not significant", "non-significant", "negligible", "minimal", "no significant", "marginal", "modest effect", "no effect"]
NEGATION = r"\b(not|no|never|doesn't|don't|didn't|cannot|can't|fail|lack|without|absence|depleted|deficient|loss of)\b"
INDUCES = ["induces senescence", "promotes senescence", "drives senescence", "triggers senescence", "induc", "upregul", "increas", "elevat", "activat", "overexpress", "amplif"]
INHIBITS = ["inhibits senescence", "blocks senescence", "prevents senescence", "suppresses senescence", "inhibit", "downregul", "decreas", "reduc", "lower", "suppress", "silenc", "repress"]
SHORT_NEGATION = ["not ", "no ", "without ", "absence of ", "fails to ", "does not ", "doesn't "]
UPPER_GENE, HYPHEN_GENE, TITLE_GENE = r"(?U)\b([A-Z][A-Z0-9]{1,9})\b", r"(?U)\b([a-z]{2,4}-\d+[a-z]?)\b", r"(?U)\b([A-Z][a-z0-9]{1,9})\b"
UPPER_STOP = [
    "A", "B", "C", "D", "E", "F", "G", "I", "THE", "AND", "OR", "NOT", "BUT", "FOR", "WITH", "IN", "ON", "AT", "TO", "FROM", "BY", "AS",
    "IS", "ARE", "WAS", "WERE", "BE", "BEEN", "HAVE", "HAS", "HAD", "DO", "DOES", "DID", "WILL", "WOULD", "SHALL", "SHOULD", "MAY",
    "MIGHT", "MUST", "CAN", "COULD", "NO", "YES", "SO", "IF", "THEN", "ELSE", "WHEN", "WHERE", "HOW", "WHAT", "WHO", "WHY", "ALL", "BOTH",
    "EACH", "FEW", "MORE", "OTHER", "SOME", "SUCH", "THAN", "TOO", "VERY", "ALSO", "AFTER", "BEFORE", "WHILE", "SINCE", "UNTIL", "RNA",
    "DNA", "PCR", "GEO", "OIS", "DDIS", "REP", "IMR", "HFF", "LOG", "FC", "SD", "CI", "MCQ", "LB", "SEN", "UP", "DOWN", "LIMMA", "DEG",
    "DEGS", "RNASEQ", "MRNA", "QPCR", "CHIP", "PI", "SEM", "MAE", "AUC", "ROC", "HR", "OR", "RR", "WT", "KO", "OE", "KD", "CKO", "GOF",
    "LOF", "SNP", "CNV", "TPM", "FPKM",
]
TITLE_STOP = [
    "The", "And", "But", "For", "With", "From", "Into", "Onto", "Upon", "This", "That", "These", "Those", "There", "Their", "They",
    "Them", "When", "Where", "What", "Which", "While", "Whose", "Whom", "Cell", "Cells", "Gene", "Genes", "Type", "Types", "Study",
    "Studies", "Data", "Result", "Results", "Model", "Models", "Test", "Tests", "Group", "Groups", "Level", "Levels", "Value", "Values",
    "Figure", "Table", "Section", "Note", "Method", "Methods", "Step", "Steps", "Case", "Cases", "Time", "Times", "Day", "Days", "Week",
    "Weeks", "Year", "Years", "Hour", "Hours", "Minute", "Minutes", "Mouse", "Rat", "Human", "Yeast", "Fly", "Worm", "Cell", "Tissue",
    "Both", "Each", "All", "Some", "Most", "Many", "Few", "Yes", "No", "True", "False", "None", "Page", "Line", "Row", "Column", "Index",
]
WEIGHTS = (0.4, 0.2, 0.4)
CONTEXT, LOOK_BACK, SHORT_LOOK_BACK = 250, 50, 30


def _among(low: Column, words: list[str]) -> Column:
    """Those of the words that occur in a lower-case text; one expression however many words there are."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def occurring(low: Column, words: list[str]) -> Column:
    """Those of the words that occur in a lower-case text, by a search over its bytes; none for a null text."""
    pairs = [(w, w.encode()) for w in words]

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else [w for w, b in pairs if b in x] for x in texts])

    return found(low.cast("binary"))


def keyword_hits(low: Column, words: list[str], among: Column | None = None) -> Column:
    """Occurrences of all words in a lower-case text; one with a negation in the 50 characters before it counts as minus one.

    ``low`` should be a plain column, so that nothing is lowered again for each word; ``among`` holds those of the words that occur,
    where that is known, and may hold others."""

    def hits(total: Column, word: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            at = acc.p + F.length(part)
            before = low.substr(F.greatest(at - LOOK_BACK, F.lit(0)) + 1, F.least(F.lit(LOOK_BACK), at))
            one = F.when(before.rlike("(?iU)" + NEGATION), -1).otherwise(1)
            return F.struct((at + F.length(word)).alias("p"), (acc.c + one).alias("c"))

        parts = F.split(low, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), -1)
        found = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        return total + F.aggregate(found, F.struct(F.lit(0).alias("p"), F.lit(0).alias("c")), step).c

    return F.coalesce(F.aggregate(_among(low, words) if among is None else F.filter(among, lambda w: w.isin(words)), F.lit(0), hits), F.lit(0))


def named(low: Column, words: list[str]) -> Column:
    """How many of the words occur in a lower-case text."""
    return F.coalesce(F.size(_among(low, words)), F.lit(0))


def direction_score(pred: Column, up: Column, down: Column, none: Column) -> Column:
    """Agreement of a direction answer with hit counts: 1, 0 or 0.5."""
    return (
        F.when((up == 0) & (down == 0) & (none == 0), 0.5)
        .when(pred == "A", F.when((up > 0) & (up >= down), 1.0).when((down > 0) & (down > up), 0.0).otherwise(0.5))
        .when(pred == "B", F.when((down > 0) & (down >= up), 1.0).when((up > 0) & (up > down), 0.0).otherwise(0.5))
        .when(pred == "C", F.when((none > 0) & (F.abs(up) <= 1) & (F.abs(down) <= 1), 1.0).when((up > 1) | (down > 1), 0.0).otherwise(0.5))
        .otherwise(0.5)
    )


def significance_score(pred: Column, sure: Column, unsure: Column) -> Column:
    return (
        F.when(pred == "A", F.when((sure > 0) & (unsure == 0), 1.0).when(unsure > 0, 0.0).otherwise(0.5))
        .when(pred == "B", F.when(unsure > 0, 1.0).when(sure > 0, 0.0).otherwise(0.5))
        .otherwise(0.5)
    )


def consistency(kind: Column, text: Column, answer: Column, counts: Column) -> Column:
    """Agreement of a text with its answer by format: direction for mcq and ternary, significance for binary, else 0.5.

    ``counts`` is a struct of up, down, none, sure and unsure. A missing or empty text or answer is neutral as well."""
    pred, kind = F.upper(F.btrim(answer, F.lit(" \t\r\n"))), F.lower(F.coalesce(kind, F.lit("")))
    nothing = (F.coalesce(text, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == "")
    return (
        F.when(nothing, 0.5)
        .when(kind.isin("mcq", "ternary"), direction_score(pred, counts["up"], counts["down"], counts["none"]))
        .when(kind == "binary", significance_score(pred, counts["sure"], counts["unsure"]))
        .otherwise(0.5)
    )


def gene_candidates(text: Column) -> Column:
    """Distinct symbols in the order of the three patterns, without stop words.

    Words of different patterns cannot overlap, so that one scan finds those of all; what each is, the short word tells."""
    inside = [p.removeprefix(r"(?U)\b(").removesuffix(r")\b") for p in (UPPER_GENE, HYPHEN_GENE, TITLE_GENE)]
    found = F.regexp_extract_all(text, F.lit(rf"(?U)\b(?:{'|'.join(inside)})\b"), 0)
    upper, hyphen, title = (rf"(?U)^(?:{p})$" for p in inside)

    def in_order(words: Column) -> Column:
        named = F.filter(words, lambda x: x.rlike(upper) & ~x.isin(UPPER_STOP))
        titled = F.filter(words, lambda x: x.rlike(title) & ~x.isin(TITLE_STOP) & (F.length(x) >= 3))
        return F.array_distinct(F.concat(named, F.filter(words, lambda x: x.rlike(hyphen)), titled))

    return bound(F.array_distinct(found), in_order)


def valid_symbol(x: Column) -> Column:
    return (F.length(x) >= 2) & ~F.upper(x).isin(UPPER_STOP) & ~x.rlike("^[0-9]+$")


def context(text: Column, gene: Column) -> Column:
    """Lower-case text up to 250 characters around the first whole-word mention of a gene; null if there is none."""
    at = F.regexp_instr(text, F.concat(F.lit(r"(?iU)\b\Q"), gene, F.lit(r"\E\b")))

    def around(at: Column) -> Column:
        lo = F.greatest(at - 1 - CONTEXT, F.lit(0))
        return F.when(at > 0, F.lower(text.substr(lo + 1, at - 1 + F.length(gene) + CONTEXT - lo)))

    return bound(at, around)


def claimed_direction(ctx: Column) -> Column:
    """``induces`` or ``inhibits`` by the first keyword of each list; the one nearer the middle wins; negation flips it."""

    def first(words: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.instr(ctx, w), F.lit(0)) for w in words]) - 1

    def nearest(x: Column) -> Column:
        mid = F.floor(F.length(ctx) / 2)
        return F.struct((x.a.isNotNull() & (x.b.isNull() | (F.abs(x.a - mid) <= F.abs(x.b - mid)))).alias("induces"), x.a.alias("a"), x.b.alias("b"))

    def judged(x: Column) -> Column:
        at = F.when(x.induces, x.a).otherwise(x.b)
        before = ctx.substr(F.greatest(at - SHORT_LOOK_BACK, F.lit(0)) + 1, F.least(F.lit(SHORT_LOOK_BACK), at).cast("int"))
        flipped = F.exists(F.array(*map(F.lit, SHORT_NEGATION)), lambda w: F.contains(before, w))
        return F.when(at.isNull(), F.lit(None)).when(x.induces != flipped, "induces").otherwise("inhibits")

    return bound(bound(F.struct(first(INDUCES).alias("a"), first(INHIBITS).alias("b")), nearest), judged)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.transform(F.array(value), f)[0]


def faithfulness(gene: Column, keyword: Column, prop: Column) -> Column:
    return F.round(WEIGHTS[0] * gene + WEIGHTS[1] * keyword + WEIGHTS[2] * prop, 4)
