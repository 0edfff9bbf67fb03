import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relearn.functions import text
from relearn.sources.responses import parse_model_responses

SAMPLES = [
    None, "", "  ", "Hello, World! 12", "ＡＢＣ　１２", "Straße", "ǅ x", "ﬁne", "nǐ hǎo", "ｶﾞ", "①②", "拼音：减法",
    "áb", "　 x  ", "İstanbul", "x y", "答案 42", "²", "ⅷ", "𝔘nicode", "é", "가",
]


def python_fold(value, kind):
    case, kept, toneless = text.FOLDS[kind]
    out = case(unicodedata.normalize("NFKC", value or ""))
    if toneless:
        out = "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c))
    return "".join(c for c in out if unicodedata.category(c)[0] in kept)


@pytest.mark.parametrize("kind", sorted(text.FOLDS))
def test_folded_matches_python(spark, kind):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, s string")
    got = dict(df.select("i", text.folded(F.col("s"), kind)).collect())
    assert got == {i: python_fold(s, kind) for i, s in enumerate(SAMPLES)}


def test_strip_and_casefold_match_python(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES[1:])), "i int, s string")
    rows = df.select("i", text.strip(F.col("s")), text.casefold_words(F.col("s"))).collect()
    for i, stripped, words in rows:
        assert stripped == SAMPLES[1:][i].strip()
        assert words == " ".join(SAMPLES[1:][i].casefold().split())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0, max_codepoint=127), max_size=20))
def test_plain_text_shortcut_is_exact(value):
    """On ASCII the folds equal lower case plus a character filter."""
    kept = "".join(c for c in value.lower() if c.isascii() and c.isalnum())
    assert all(python_fold(value, kind) == kept for kind in text.FOLDS)


def test_ideographs_fold_to_themselves():
    block = "".join(map(chr, range(0x4E00, 0xA000)))
    assert all(python_fold(block, kind) == block for kind in text.FOLDS)


def test_stripping_reads_a_text_once_and_parsing_strips_once(spark):
    rng = random.Random(3)
    odd = [" ", "\n", "\r\n", "\x1c", "\x85", "　", " ", "a", "é", "😀", "{}", "-"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 9))) for _ in range(400)] + ["", None, "x" + " " * 5000 + "y\n", " " * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    for r in rows.select("id", text.strip(F.col("content")).alias("s"), text.is_blank(F.col("content")).alias("b")).collect():
        t = texts[r.id]
        assert (r.s, r.b) == ((None, True) if t is None else (t.strip(), not t.strip()))
    plan = parse_model_responses(rows, "content", "a string")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(content#") == 1 and "regexp_replace(content#" not in plan
