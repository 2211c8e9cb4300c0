import random
import re

import pyspark.sql.functions as F
import pytest

from spanveil.config import PROFILES, bundle
from spanveil.functions import validators
from spanveil.functions.dialect import Untranslatable, compile_pattern, translate
from spanveil.functions.finditer import finditer, matches, python_finditer
from spanveil.functions.normalize import edits, map_spans, normalized, original
from spanveil.schema import SPANS

ALPHABET = ["ООО ", "оао", "«", "»", '"', "“", "Ромашка", " ", "\n", "\r\n", "-\n", "-", "—", "в лице ", "действующего на основании доверенности", " № ", "77-АА", " от ", "01.02.2023",
    "a.b@c.de", "http://x.ru/a?b", "1027700132195", "7707083893", "044525225", "40702810900000000001", ",", ".", "ул. Ленина, дом 5", "г. Москва", "кв", " и так далее", "😀", "x", "Общество с ограниченной ответственностью "]


def texts(n=300, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 25))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("profile", ["shipped", "documented"])
def test_all_patterns_match_like_python(spark, profile):
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")
    patterns = {n: p for n, p in bundle(PROFILES[profile]).patterns.items() if not p.never}
    assert all(p.java for p in patterns.values())
    found = df.select("id", *[matches(F.col("text"), p).alias(n) for n, p in patterns.items()]).collect()
    for row in found:
        for name, p in patterns.items():
            want = [(m.start(), m.end(), m[0]) for m in re.finditer(p.python, rows[row["id"]] or "", p.flags)]
            assert [(m["start"], m["end"], m["text"]) for m in row[name]] == want, (name, rows[row["id"]])


def test_groups_and_python_engine(spark):
    p = compile_pattern("p", r"(a+)(b)?(?P<rest>c)", [])
    df = spark.createDataFrame([("xaabc-ac-bc😀aaac",), (None,)], "t string")
    one = df.select(finditer(F.col("t"), p.java, (1, 2, 3)).alias("a"), python_finditer(p, (1, 2, 3))(F.col("t")).alias("b")).collect()
    assert one[0]["a"] == one[0]["b"] and [list(m["groups"]) for m in one[0]["a"]] == [["aa", "b", "c"], ["a", "", "c"], ["aaa", "", "c"]]
    assert one[1]["a"] == one[1]["b"] == []


@pytest.mark.parametrize(("pattern", "flags", "java"), [
    ("a b # c\n[ #]", re.X, "(?dU)ab[ #]"),
    ("(?P<n>x)(?P=n)", 0, r"(?dU)(?<n>x)\k<n>"),
    ("[[a&&b]", re.I, r"(?dUi)[\[a\&\&b]"),
    ("[]a]", 0, r"(?dU)[\]a]"),
    ("[^]a]", 0, r"(?dU)[^\]a]"),
    (r"(?im)^x$\Z", 0, r"(?dUim)^x$\z"),
    (r"a\ b\[c", re.X, r"(?dU)a\ b\[c"),
    (".", re.S, "(?dUs)."),
])
def test_dialect(pattern, flags, java):
    assert translate(pattern, flags) == java


@pytest.mark.parametrize("pattern", ["(a)?(?(1)b|c)", "(?P<a_b>x)", r"\N{DIGIT ONE}", "(?a)x", "(?-i:x)"])
def test_what_java_cannot_express_runs_in_python(spark, pattern):
    with pytest.raises(Untranslatable):
        translate(pattern, 0)


def test_bad_patterns_are_named():
    with pytest.raises(ValueError, match="org_pattern"):
        compile_pattern("org_pattern", "([unclosed", [])
    with pytest.raises(ValueError, match="empty"):
        compile_pattern("x", "a*", [])
    assert compile_pattern("x", "a", ["I"]).flags == re.I | re.U


@pytest.mark.parametrize(("kind", "text", "good"), [
    ("INN", "7707083893", True), ("INN", "7707083894", False), ("INN", "500100732259", True), ("INN", "500100732250", False), ("INN", "77 07-083893", True), ("INN", "123", False),
    ("OGRN", "1027700132195", True), ("OGRN", "1027700132194", False), ("KPP", "123456789", True), ("BIK", "044525225", True), ("RS", "40702810900000000001", True), ("KS", "30101810400000000225", True),
    ("KS", "3010181040000000022", False), ("INN", "", False), ("INN", None, False), ("OGRN", None, False), ("KPP", None, False),
])
def test_validators(spark, kind, text, good):
    validators.register(spark)
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(validators.VALIDATORS[kind](F.col("t"))).first()[0] is good
    assert df.selectExpr(f"validate_{kind.lower()}(t)").first()[0] is good


def plain_normal(text):
    """Normalised text and for each of its characters the place in the given text."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "\r" and text[at + 1 : at + 2] == "\n":
            at += 1
            continue
        step = re.compile(r"-\r?\n").match(text, at)
        if step and at and text[at - 1].isalpha() and text[step.end() : step.end() + 1].isalpha():
            at = step.end()
            continue
        out.append(({**dict.fromkeys("«»”„", '"'), **dict.fromkeys("—–−", "-")}.get(text[at], text[at]), at))
        at += 1
    return "".join(c for c, _ in out), [i for _, i in out]


def test_normal_text_and_offsets(spark):
    rows = [t for t in texts(200, 7) if t is not None] + ["компа-\nния", "а-\nб-\nв", "“A”", "a\r\nb\rc", "x-\r\ny", "-\nа", "а-\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string").withColumn("norm", normalized(F.col("t"))).withColumn("e", edits(F.col("t")))
    every = F.transform(F.sequence(F.lit(0), F.length("norm")), lambda k: original(k, F.col("e")))
    for row in df.select("id", "norm", every.alias("map")).collect():
        norm, place = plain_normal(rows[row["id"]])
        assert row["norm"] == norm and list(row["map"])[: len(norm)] == place
    one = spark.createDataFrame([("компа-\nния x",)], "t string").select(map_spans(F.array(F.struct(F.lit(9).alias("start"), F.lit(10).alias("end"))), edits(F.col("t"))).alias("s")).first()["s"][0]
    assert (one["start"], one["end"]) == (11, 12)


def test_span_type_is_one(spark):
    assert spark.createDataFrame([], f"s {SPANS}").schema["s"].dataType.elementType.fieldNames() == ["start", "end", "label", "score", "source", "labels_joined", "extra_label", "ord"]
