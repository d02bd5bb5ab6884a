"""Text perturbations as folds of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Made-up symbols and directional word pairs, each swapped both ways.
FAKE_GENES = ["XYZQ1", "FAKE7", "BOGN3", "NULLP2"]
PAIRS = [("extends", "shortens"), ("increase", "decrease"), ("increases", "decreases"), ("increased", "decreased"), ("upregulated", "downregulated"), ("upregulates", "downregulates"), ("longer", "shorter"), ("elevated", "reduced"), ("activate", "inhibit"), ("activates", "inhibits"), ("activated", "inhibited"), ("promotes", "suppresses"), ("promote", "suppress"), ("enhanced", "diminished"), ("pro-longevity", "anti-longevity"), ("lifespan extension", "lifespan shortening")]
#: First of the private characters that stand for words on their way to the other side.
PRIVATE = 0xE000


def swaps() -> list[tuple[str, str, str]]:
    """(word, private character, its opposite), longer words first."""
    both = sorted({(a, b) for x, y in PAIRS for a, b in ((x, y), (y, x))}, key=lambda p: (-len(p[0]), p[0]))
    return [(a, chr(PRIVATE + i), b) for i, (a, b) in enumerate(both)]


def flipped(text: Column) -> Column:
    """Every directional word in its opposite. No two of the words can overlap, so that one pattern cuts the text around all of them
    and each is looked up; private characters that stand for words become these."""
    pairs = swaps()
    pattern = rf"(?iU)\b(?:{'|'.join(word for word, _, _ in pairs)})\b"
    opposite = F.create_map(*[F.lit(x) for word, _, other in pairs for x in (word, other)])
    plain = lambda x: F.lower(F.translate(x, "\u0130\u0131\u017f", "iis"))  # noqa: E731  all that the pattern takes for a letter
    others = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.try_element_at(opposite, plain(x)))
    joined = F.array_join(F.zip_with(F.split(text, pattern, -1), others, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    spelt = joined
    for _, mark, other in pairs:
        spelt = F.replace(spelt, F.lit(mark), F.lit(other))
    return F.when(text.rlike(f"[{pairs[0][1]}-{pairs[-1][1]}]"), spelt).otherwise(joined)


def wrong_genes(text: Column, genes: Column, most: int = 2, among: int = 4) -> Column:
    """The first mentions of up to ``most`` of the first ``among`` genes become made-up symbols."""
    fakes = F.array(*map(F.lit, FAKE_GENES))

    def one(state: Column, gene: Column) -> Column:
        at = F.regexp_instr(state.text, F.concat(F.lit(r"(?U)\b\Q"), gene, F.lit(r"\E\b")))
        fake = F.get(fakes, state.used)
        put = F.concat(state.text.substr(F.lit(1), at - 1), fake, state.text.substr(at + F.length(gene), F.length(state.text)))
        changes = (state.used < most) & (at > 0) & (gene != fake)
        return F.when(changes, F.struct(put.alias("text"), (state.used + 1).alias("used"))).otherwise(state)

    found = F.coalesce(genes, F.array().cast("array<string>"))
    return F.aggregate(F.slice(found, 1, among), F.struct(text.alias("text"), F.lit(0).alias("used")), one).text
