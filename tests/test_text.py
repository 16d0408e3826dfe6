import random

from pyspark.sql import functions as F

from quillset.functions import text
from quillset.functions.html import clean_text, strip_html


def evaluate(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("v")).first()["v"]


def test_trim_uses_ecmascript_white_space(spark):
    assert evaluate(spark, text.js_trim(F.col("t")), t="﻿　 \t a b \n ") == "a b"


def test_hash_matches_fnv_over_utf16_units(spark):
    def expected(value):
        h = 2166136261
        raw = value.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits

    samples = ["a|b", "中文|é", "x\U0001F600y", "doc_1|chunk_001|如何?|答案"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r["h"] for r in df.select(text.base36_hash(F.col("s")).alias("h")).collect()]
    assert got == [expected(s) for s in samples]


def test_units_mix_latin_tokens_and_han_pairs(spark):
    assert evaluate(spark, text.text_units(F.col("t")), t="GPT-4 模型 v1.2 中") == ["gpt-4", "v1.2", "模型", "型中"]
    assert evaluate(spark, text.text_units(F.col("t")), t="ok 中") == ["ok", "中"]


def test_grams_of_short_texts(spark):
    assert evaluate(spark, text.grams(F.col("t"), 2), t="a") == []
    assert evaluate(spark, text.bigram_set(F.col("t")), t="a") == ["a"]
    assert evaluate(spark, text.search_grams(F.col("t")), t="ab") == ["ab"]
    assert evaluate(spark, text.search_grams(F.col("t")), t="") == []


def test_search_synonyms_apply_twice_for_tokens(spark):
    norm = evaluate(spark, text.search_norm(F.col("t")), t="怎么进行调整流程")
    assert norm == "如何进行配置方法"
    tokens = evaluate(spark, text.search_tokens(F.lit(norm)), t="")
    assert "如何配置方法" in tokens and "如何" in tokens


def test_half_up_rounding(spark):
    assert evaluate(spark, text.round_half_up(F.col("x"), 3), x=0.0005) == 0.001
    assert evaluate(spark, text.round_half_up(F.col("x"), 3), x=0.8124999) == 0.812


def test_html_strip_keeps_headings_and_decodes_twice(spark):
    html = "<h2 class=a>Ti&amp;tle</h2><p>one<br>two&nbsp;&amp;#65;&#20013;</p><script>x</script><STYLE>p{}</STYLE><b>z</b>"
    got = evaluate(spark, clean_text(strip_html(F.col("t"))), t=html)
    assert got == "## Ti&tle\none\ntwo A中\nz"


def test_clean_text_collapses_blank_lines(spark):
    assert evaluate(spark, clean_text(F.col("t")), t="  a \n\n \n\n\n b　\n") == "a\n\nb"


def test_grams_match_plain_python(spark):
    rng = random.Random(5)
    samples = ["".join(rng.choice("ab中c文") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for row in df.select("s", text.grams(F.col("s"), 3).alias("g")).collect():
        assert sorted(row["g"]) == sorted({row["s"][i : i + 3] for i in range(len(row["s"]) - 2)})
