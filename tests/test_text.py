"""Masks, text functions, style and statistics on literals."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import masks, stats, style, text


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_masks(spark):
    cases = {
        "mail ann.b+c@host.example.org now": "mail <EMAIL> now",
        "see https://a.example/x?y=1, ok": "see <URL> ok",
        "ask @some_one or @me": "ask <HANDLE> or @me",
        "at -34.6037, -58.3816 here": "at <COORDS> here",
        "cbu 1234567890123456789012.": "cbu <CBU>.",
        "iban ES9121000418450200051332 x": "iban <IBAN> x",
        "call +54 11 4444-5555 today": "call <PHONE> today",
        "at 9:30 or 10:15:20 p.m. then": "at 9:30 or 10:15:20 p.m. then",
        "meet 9:30 call 11 4444-5555 at 18:00": "meet 9:30 call <PHONE> at 18:00",
        "id 1234567 only": "id <ID> only",
        "id 35123456 is a phone": "id <PHONE> is a phone",
        "room 123 floor 4": "room 123 floor 4",
        "ref:123456789 x": "ref:<NUM> x",
        "user@host only": "user<HANDLE> only",
        "": "",
    }
    assert values(spark, list(cases), masks.anonymize("t")) == list(cases.values())
    assert values(spark, ["id 35123456 x", None], masks.anonymize("t", id_first=True)) == ["id <ID> x", None]


def test_masks_twice_are_once(spark):
    texts = ["a@b.example and +1 (555) 123-4567 at 9:30", "x 1234567 https://y.example"]
    assert values(spark, texts, masks.anonymize(masks.anonymize("t"))) == values(spark, texts, masks.anonymize("t"))


def test_names(spark):
    df = spark.createDataFrame([("Nora met Pablo in Quito.",), ("",)], "t string")
    find = masks.gazetteer({"Nora": "PER", "Pablo": "PER", "Quito": "LOC", "Sun": "MISC"})
    out = [r.t for r in masks.anonymize_names(df, "t", find, keep=("nora",)).collect()]
    assert out == ["Nora met <PER> in <LOC>.", ""]
    assert [r.t for r in masks.anonymize_names(df, "t", find, keep=("nora",), keep_author=False).collect()][0] == "<PER> met <PER> in <LOC>."
    assert masks.anonymize_names(df, "t", None) is df
    with pytest.raises(RuntimeError):
        masks.anonymize_names(df, "t", None, strict=True)


def test_normal_form(spark):
    same = ["Hola  Mundo", " hola mundo ", "HOLA\tMUNDO\n", " hola mundo"]
    assert len(set(values(spark, same, text.normal_hash("t")))) == 1
    assert values(spark, ["año  Ñ"], text.normal_form("t")) == ["año ñ"]


@pytest.mark.parametrize("n", [0, 1, 399, 400, 401, 750, 751, 1200])
def test_chunks_cover_all_words(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = values(spark, [" ".join(words)], text.word_chunks("t"))[0]
    want, k = [], 0
    while words:
        want.append(" ".join(words[k : k + 400]))
        if k + 400 >= n:
            break
        k += 350
    assert got == want


def test_chunk_arguments():
    with pytest.raises(ValueError):
        text.word_chunks("t", 10, 10)


def test_cuts(spark):
    long = "One. " * 100 + "tail " * 100
    assert values(spark, ["short", "x" * 700, long], text.cut_at_sentence("t")) == ["short", "x" * 600, ("One. " * 100).strip()]
    assert values(spark, ["a<EOS>", "b"], text.append_once("t", "<EOS>")) == ["a<EOS>", "b<EOS>"]
    df = spark.createDataFrame([("say hi", "say hi <b>hello</b> "), ("p", "no echo")], "p string, g string")
    assert [r[0] for r in df.select(text.after_echo("g", "p")).collect()] == ["hello", "no echo"]


def test_style(spark):
    t = "Che boludo, che! ¿Qué onda? Jaja 😀😀 dale."
    v = dict(zip(style.METRICS, values(spark, [t], F.array(*style.style_vector("t")))[0], strict=True))
    assert v["regional_rate"] == pytest.approx(5 * 100 / 8)
    assert v["interjection_rate"] == pytest.approx(100 / 8)
    assert v["emoji_density"] == pytest.approx(100 / len(t))
    assert values(spark, ["", "!!"], F.array(*style.style_vector("t"))) == [[0.0] * 5] * 2
    assert values(spark, ["jajaja ñche"], style.lexicon_rate("t", ["jaja", "che"])) == [0.0]


def test_intervals(spark):
    df = spark.createDataFrame([(8, 10), (0, 5), (5, 5), (0, 0)], "c long, n long")
    got = df.select(*stats.wilson(F.col("c"), F.col("n"))).collect()
    p, n, z = 0.8, 10, 1.96
    mid, half = (p + z * z / 2 / n) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)
    assert got[0][0] == pytest.approx(mid - half) and got[0][1] == pytest.approx(mid + half)
    assert got[1][0] == 0.0 and got[2][1] == 1.0 and got[3][0] is None
    z = spark.createDataFrame([(x / 10,) for x in range(50)], "z double")
    for r in z.select("z", stats.normal_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, abs=1e-7)
    d = spark.createDataFrame([(10, None), (10, 0), (25, 10**9), (1, 3 * 10**9)], "c long, d long")
    assert [r[0] for r in d.select(stats.tokens_per_second(F.col("c"), F.col("d"))).collect()] == [1e10, 1e10, 25.0, 0.3]
