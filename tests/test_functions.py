"""Small cases with expected values worked out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gradus.functions import labels, text, trace
from gradus.operators import metrics


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values)))
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("The answer is B, not C.", "C"), ("ABC", None), ("xA B", "B"), ("", None)])
def test_last_letter(spark, given, want):
    assert one(spark, text.last_letter, given) == want


@pytest.mark.parametrize(("given", "want"), [("", None), ("dog", "D"), ("__dry_run__", "_")])
def test_letter_or_first(spark, given, want):
    assert one(spark, text.letter_or_first, given) == want


@pytest.mark.parametrize(("given", "want"), [("ßheit", "ẞ"), (" \n\f\r\tßx", "ẞ"), ("ŉx", "ŉ"), ("ᾳx", "ᾼ"), ("éx", "É"), ("\x0bx", "\x0b"), (" \n", None)])
def test_first_character_keeps_its_length(spark, given, want):
    """A letter whose upper case is several letters in text has one capital, or stays."""
    assert one(spark, text.letter_or_first, given) == want


def test_numbers(spark):
    assert one(spark, text.first_number, "age 54, maybe 60.5") == 54.0
    assert one(spark, text.last_number_rounded, "age 54, maybe 60.5") == "60"
    assert one(spark, text.last_number_rounded, "none") == "0"


@pytest.mark.parametrize(("given", "kind", "want", "changed"), [("b", "binary", "B", True), ("B", "binary", "B", False), ("Answer: C", "binary", "A", True), ("", "regression", "0", True), ("\\boxed{ d }", "mcq", "D", True), ("free", "other", "free", False)])
def test_coerced(spark, given, kind, want, changed):
    assert one(spark, lambda c: text.coerced(c, kind), given) == want
    assert one(spark, lambda c: text.was_coerced(c, kind), given) is changed


@pytest.mark.parametrize(("given", "why", "answer"), [("x</think> A", "x", "A"), ("A", None, "A"), ("foo<think>b</think>C", "foo<think>b", "C")])
def test_reasoning(spark, given, why, answer):
    assert one(spark, text.reasoning, given) == why
    assert one(spark, text.after_reasoning, given) == answer


def test_jaccard(spark):
    assert one(spark, lambda a, b: text.jaccard(text.label_set(a), text.label_set(b)), "a,b", "b;c") == pytest.approx(1 / 3)
    assert one(spark, lambda a, b: text.jaccard(text.label_set(a), text.label_set(b)), "", " ; ") is None


@pytest.mark.parametrize(("age", "want"), [(20.0, "20-39"), (40.0, "40-59"), (80.0, "80+"), (19.0, None)])
def test_bracket(spark, age, want):
    assert one(spark, lambda c: labels.bracket(c, [20, 40, 60, 80, 200], ["20-39", "40-59", "60-79", "80+"]), age) == want


@pytest.mark.parametrize(("fc", "p", "want"), [(1.0, 0.01, "no_change"), (1.01, 0.05, "no_change"), (-1.01, 0.049, "downregulated"), (1.01, 0.049, "upregulated")])
def test_ternary(spark, fc, p, want):
    assert one(spark, labels.ternary_label, fc, p) == want


def test_null_treatment_passes(spark):
    df = spark.createDataFrame([(None, "OIS"), ("none", "OIS"), ("x", "REP"), ("x", "zz")], "t string, c string")
    assert df.filter(labels.treatment_filter(F.col("t"), F.col("c"), ["OIS", "REP"])).count() == 2


@pytest.mark.parametrize(("x", "want"), [(3.01, "3.01"), (1000.0, "1000"), (0.000012, "1.2e-05"), (2.0, "2")])
def test_significant_digits(spark, x, want):
    assert one(spark, text.significant_digits, x) == want


def test_negated_keyword(spark):
    assert one(spark, lambda t: trace.keyword_hits(t, ["increas"]), "it does not increase") == -1
    assert one(spark, lambda t: trace.keyword_hits(t, ["increas"]), "increases. " + "x" * 60 + " increase") == 2
    assert one(spark, lambda p, t: trace.significance_score(p, trace.keyword_hits(t, trace.SIGNIFICANT), trace.named(t, trace.NOT_SIGNIFICANT)), "B", "not significant") == 1.0


def test_genes(spark):
    assert one(spark, trace.gene_candidates, "FOXO3 THE daf-2 Trp53 The") == ["FOXO3", "daf-2", "Trp53"]


def test_direction(spark):
    far = "induces senescence " + "y" * 300 + " GENE1 is reduced"
    assert one(spark, lambda t: trace.claimed_direction(trace.context(t, F.lit("GENE1"))), far) == "inhibits"
    assert one(spark, lambda t: trace.claimed_direction(trace.context(t, F.lit("GENE1"))), "GENE1 does not inhibit it") == "induces"
    assert one(spark, lambda t: trace.claimed_direction(trace.context(t, F.lit("GENE1"))), "GENE1 alone") is None


def test_faithfulness(spark):
    assert one(spark, trace.faithfulness, 1.0, 0.5, 0.5) == 0.7


@pytest.mark.parametrize(("given", "want"), [("Answer: B", "A"), ("b", "B"), ("ibd", "A"), ("x control", "B"), ("C", "C")])
def test_normal_answer(spark, given, want):
    assert one(spark, text.normal_answer, given) == want


GOLDEN = [
    ([[1, 14, 32, 0], [1, 17, 28, 0], [1, 10, 25, 0], [0, 5, 4, 0]], 0.312, 0.202, 0.271),
    ([[12, 15, 20, 0], [5, 26, 15, 0], [11, 11, 14, 0], [0, 4, 5, 0]], 0.377, 0.285, 0.302),
    ([[26, 21, 0, 0], [24, 22, 0, 0], [20, 16, 0, 0], [0, 9, 0, 0]], 0.348, 0.208, 0.258),
]


@pytest.mark.parametrize(("matrix", "acc", "f1", "bal"), GOLDEN)
def test_published_matrices(spark, matrix, acc, f1, bal):
    rows = [("m", "ABCD"[i], "ABCD"[j]) for i, r in enumerate(matrix) for j, n in enumerate(r) for _ in range(n)]
    df = spark.createDataFrame(rows, "model string, gold string, pred string")
    assert metrics.accuracy(df, ["model"]).first()["accuracy"] == pytest.approx(acc, abs=6e-4)
    assert metrics.macro_f1(df, ["model"]).first()["macro_f1"] == pytest.approx(f1, abs=6e-4)
    assert metrics.balanced_accuracy(df, ["model"]).first()["balanced_accuracy"] == pytest.approx(bal, abs=6e-4)
    assert metrics.confusion_matrix(df, ["model"]).count() == 16


def test_off_by_one(spark):
    got = [one(spark, metrics.off_by_one_score, "A", p) for p in "ABC"]
    assert got == [1.0, 0.5, 0.0]
    df = spark.createDataFrame([("A", None)], "g string, p string")
    assert df.select(metrics.off_by_one_score(F.col("g"), F.col("p"))).first()[0] == 0.0


def test_constant_spearman_is_zero(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 1.0, 3.0)], "model string, gold double, pred double")
    assert metrics.spearman(df, ["model"]).first()["rho"] == 0.0


def test_consistency_dispatch(spark):
    rows = [("mcq", "it increases", "A", 1.0), ("Ternary", "it increases", " a ", 1.0), ("ternary", "it increases", "b", 0.0), ("binary", "significant", "a", 1.0), ("pairwise", "it increases", "A", 0.5), ("regression", "increases", "A", 0.5), (None, "increases", "A", 0.5), ("mcq", None, "A", 0.5), ("mcq", "", "A", 0.5), ("mcq", "increases", None, 0.5), ("mcq", "increases", "", 0.5)]
    df = spark.createDataFrame(rows, "fmt string, t string, pred string, want double").withColumn("low", F.lower("t"))
    low = F.col("low")
    counts = {"up": trace.keyword_hits(low, trace.UP), "down": trace.keyword_hits(low, trace.DOWN), "none": trace.named(low, trace.NO_CHANGE), "sure": trace.keyword_hits(low, trace.SIGNIFICANT), "unsure": trace.named(low, trace.NOT_SIGNIFICANT)}
    got = df.select("*", trace.consistency(F.col("fmt"), F.col("t"), F.col("pred"), counts).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_wrong_genes_takes_the_first_mentions(spark):
    from gradus.functions import perturb

    df = spark.createDataFrame([("TP53 and RB1, TP53x TP53; MYC", ["NOPE", "TP53", "MYC", "RB1", "TP53x"]), ("none here", ["A"]), ("x", None), (None, ["TP53"])], "t string, g array<string>")
    got = [r[0] for r in df.select(perturb.wrong_genes(F.col("t"), F.col("g"))).collect()]
    assert got == ["XYZQ1 and RB1, TP53x TP53; FAKE7", "none here", "x", None]


def test_flipped_never_swaps_back(spark):
    from gradus.functions import perturb

    assert one(spark, perturb.flipped, "It Increases and decreases; promotes lifespan extension, preincrease") == "It decreases and increases; suppresses lifespan shortening, preincrease"


def test_instructions(spark):
    rows = [("s", "q", "a")]
    df = spark.createDataFrame(rows, "s string, u string, a string")
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in (("system", "s"), ("user", "u"))])
    got = df.select(text.instructed(m, "mcq", thinking=True).alias("m")).first()["m"]
    assert [x["content"] for x in got] == ["s" + text.INSTRUCTIONS["mcq"], "q" + text.REMINDERS["mcq"]]
    got = df.select(text.instructed(m, "other", thinking=True).alias("m")).first()["m"]
    assert [x["content"] for x in got] == ["s", "q"]


def test_patched_keeps_types_order_and_nesting(spark):
    def out(x, name="split", value="test"):
        return one(spark, lambda c: text.patched(c, name, F.lit(value)), x)

    given = '{"z": 5, "b": true, "split": "x", "o": {"y": [1, null, 2.5], "x": {"e": ""}}, "n": null, "s": "q\\"\\n", "a": 0.125, "big": 9007199254740993}'
    got = json.loads(out(given))
    assert got == json.loads(given) | {"split": "test"} and list(got) == list(json.loads(given))
    assert type(got["z"]) is int and got["b"] is True and got["big"] == 9007199254740993
    assert list(json.loads(out('{"a": 1}'))) == ["a", "split"]
    assert [out(x) for x in (None, "", "  ", "{}")] == ['{"split":"test"}'] * 4
    assert [out(x) for x in ("no json", "[1]", "5", '"x"', '{"a": ')] == [None] * 5
    assert json.loads(out('{"a": [], "t": {}}', "a", 7)) == {"a": 7, "t": {}}


def test_canonical_json_is_that_of_sorted_keys(spark):
    odd = ["plain", 'quo"te', "back\\slash", "tab\tnew\nret\rbf\b\f", "".join(map(chr, range(1, 32))) + "\x7f", "é 数 🙂 \u2028 /", "", None]
    rows = [([{"role": r, "content": c}], {"z": 1, "a": None, "é": 3}, True) for r in ("user", None) for c in odd] + [([], {}, False), (None, None, None)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>, n map<string,int>, b boolean")
    for c in ("m", "n", "b"):
        got = df.select(text.canonical_json(F.col(c), df.schema[c].dataType).alias("j"), text.canonical_hash(F.col(c), df.schema[c].dataType).alias("h")).collect()
        values = [dict(zip("mnb", r))[c] for r in rows]
        want = [json.dumps(v, sort_keys=True, ensure_ascii=False) for v in values]
        assert [r["j"] for r in got] == want
        assert [r["h"] for r in got] == [hashlib.sha256(w.encode()).hexdigest() for w in want]
    with pytest.raises(TypeError):
        text.canonical_json(F.col("x"), DoubleType())


def test_overlay_keeps_order_and_skips_blanks(spark):
    maps = [({"a": "1", "b": "", "c": "3"}, {"c": " x ", "d": "4", "a": "  "}, {"e": None, "b": "2", "d": "5"}), (None, None, {"k": "v"}), ({"a": None}, {"a": ""}, None)]
    df = spark.createDataFrame(maps, "x map<string,string>, y map<string,string>, z map<string,string>")
    got = [list(r["m"].items()) for r in df.select(text.overlaid(F.col("x"), F.col("y"), F.col("z")).alias("m")).collect()]
    assert got == [[("a", "1"), ("b", "2"), ("c", "x"), ("d", "5")], [("k", "v")], [("a", None)]]


def test_tokens_by_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from gradus.functions import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [([{"role": "user", "content": c}],) for c in ("Some words, and 12 more.", "", "数字 🙂", "long " * 2000)] + [([],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    got = [r["n"] for r in df.select(text.token_count(F.col("m"), tokens.by_tokenizer(path, most=2)).alias("n")).collect()]
    own = Tokenizer.from_file(path)
    assert got == [len(own.encode("\n".join(f"<{x['role']}>\n{x['content']}" for x in r[0])).ids) for r in rows]
    none = spark.createDataFrame([(None,)], "t string").select(tokens.by_tokenizer(path)(F.col("t")).alias("n")).first()["n"]
    assert none == 0
