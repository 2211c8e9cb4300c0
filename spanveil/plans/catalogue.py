"""Registered queries over the test tables, with DuckDB SQL for those that SQL can express.

The tables hold no Russian contracts. Queries that need them read a contract for each customer, made by SQL text that both engines run alike.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROFILES, bundle
from ..functions import sql, validators
from ..functions.finditer import matches
from ..functions.normalize import edits, normalized, original
from ..operators import detect as detectors
from ..operators import names, structured, summary
from ..operators.mask import ALPHABET, LONGEST, SEED, SHORTEST, masked
from ..operators.merge import merged, scored, similar
from ..schema import MaskStyle, Options, span
from ..sources import files, sinks
from ..workers import shared_folder
from .pipeline import redact, redact_text

SHIPPED, DOCUMENTED = bundle(PROFILES["shipped"]), bundle(PROFILES["documented"])
PLAIN_HEADER = "ПРЕДМЕТ ДОГОВОРА"


def _sum(text: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"CAST(substr({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ") % 11 % 10"


#: doc_id, identifiers with known errors, and the text of a contract.
CONTRACTS = f"""
    SELECT n AS doc_id, inn, inn12, ogrn, kpp, rs, poa, poa_date, mail, n % 3 <> 0 AS inn_ok, n % 5 <> 0 AS inn12_ok, n % 4 <> 0 AS ogrn_ok,
        concat('ООО «Звезда ', CAST(n AS VARCHAR(12)), '», ИНН ', inn, ' и ', inn12, ', ОГРН ', ogrn, ', КПП ', kpp, ', р/с ', rs, '; почта ', mail, chr(10),
            'в лице директора, действующего на основании доверенности № ', poa, ' от ', poa_date, chr(10), chr(10),
            'Исполнитель обязуется сделать дело — ко-', chr(10), 'нец.', chr(10), chr(10), '{PLAIN_HEADER}', chr(10), 'Строим дом.', chr(10), '1. СТОРОНЫ', chr(13), chr(10), 'Конец') AS text
    FROM (
        SELECT n, kpp, rs, poa, poa_date, mail,
            concat(kpp, CAST(({_sum("kpp", validators.INN10)} + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR(2))) AS inn,
            concat(eleven, CAST(({_sum("eleven", validators.INN12)} + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR(2))) AS inn12,
            concat(twelve, CAST((CAST(twelve AS BIGINT) % 11 % 10 + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR(2))) AS ogrn
        FROM (
            SELECT n, kpp, twelve, concat('40702810', twelve) AS rs, concat('77-', CAST(n AS VARCHAR(12))) AS poa, concat('0', CAST(n % 9 + 1 AS VARCHAR(2)), '.02.20', CAST(10 + n % 15 AS VARCHAR(4))) AS poa_date,
                concat('u', CAST(n AS VARCHAR(12)), '@firm', CAST(n % 7 AS VARCHAR(2)), '.example.com') AS mail, concat(ten, CAST({_sum("ten", validators.INN11)} AS VARCHAR(2))) AS eleven
            FROM (
                SELECT c_custkey AS n, CAST(100000000 + (c_custkey * 7919) % 900000000 AS VARCHAR(20)) AS kpp, CAST(100000000000 + (c_custkey * 104729) % 900000000000 AS VARCHAR(20)) AS twelve,
                    CAST(1000000000 + (c_custkey * 15485863) % 9000000000 AS VARCHAR(20)) AS ten
                FROM customer) AS a) AS b) AS c"""
#: Spans of each order's lines.
LINE_SPANS = """
    SELECT l_orderkey AS doc_id, l_linenumber AS ord, CAST(l_partkey % 60 AS INT) AS first, CAST(l_partkey % 60 + 1 + l_suppkey % 20 AS INT) AS last,
        CASE l_partkey % 3 WHEN 0 THEN 'ROLE' WHEN 1 THEN 'PERSON' ELSE 'ORG' END AS label, CAST(0.5 + (l_suppkey % 4) * 0.125 AS DOUBLE) AS score,
        CASE l_suppkey % 3 WHEN 0 THEN 'Regex' WHEN 1 THEN 'Natasha' ELSE 'Presidio Custom' END AS source
    FROM lineitem"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, table: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {table}", "FROM {source}"), source=read(spark, sf_dir, table))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CONTRACTS, "customer")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: the test tables are single small files, which a scan can't divide. It is no part of the library's plans."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _spans(df: DataFrame, spans: Column) -> DataFrame:
    one = df.select("doc_id", "text", F.explode(spans).alias("s"))
    return one.select("doc_id", "s.label", "s.start", "s.end", F.col("text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


def _norm(df: DataFrame) -> DataFrame:
    return df.withColumn("text", normalized(F.col("text")))


# --- validators ---------------------------------------------------------------------------------------------------------------------------


def validate_inn10(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", "inn", validators.valid_inn(F.col("inn")).alias("valid"))


def validate_inn12(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", "inn12", validators.valid_inn(F.col("inn12")).alias("valid"))


def validate_ogrn(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", "ogrn", validators.valid_ogrn(F.col("ogrn")).alias("valid"))


def validate_lengths(spark, sf_dir):
    checks = [validators.VALIDATORS[k](F.col(c)).alias(f"{c}_{k.lower()}") for c in ("kpp", "rs", "inn") for k in ("KPP", "BIK", "RS", "KS")]
    return contracts(spark, sf_dir).select("doc_id", *checks)


# --- detectors ----------------------------------------------------------------------------------------------------------------------------


def detect_email(spark, sf_dir):
    return _spans(documents(spark, sf_dir), detectors.emails(F.col("text"), SHIPPED))


def detect_url(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return _spans(pages, detectors.urls(F.col("text"), SHIPPED))


def _detected_id(label: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _spans(_norm(contracts(spark, sf_dir)), detectors.identifiers(F.col("text"), SHIPPED, label))


def detect_org(spark, sf_dir):
    return _spans(_norm(contracts(spark, sf_dir)), detectors.orgs(F.col("text"), SHIPPED))


def detect_role(spark, sf_dir):
    return _spans(_norm(contracts(spark, sf_dir)), detectors.roles(F.col("text"), SHIPPED))


def subject_header(spark, sf_dir):
    return _spans(_norm(contracts(spark, sf_dir)), detectors.subjects(F.col("text"), DOCUMENTED))


def subject_keyword(spark, sf_dir):
    return _spans(_norm(contracts(spark, sf_dir)), detectors.keyword_subjects(F.col("text"), DOCUMENTED))


#: What detect_address reads, for a contract number n.
ADDRESS = "concat('Адрес: г. Москва, улица Новая, ', n, repeat(' и так далее', 3), ', дом ', n, ', этаж 2. Больше ничего. ', n)"


def detect_address(spark, sf_dir):
    text = contracts(spark, sf_dir).withColumn("n", F.col("doc_id").cast("string")).select("doc_id", F.expr(ADDRESS).alias("text"))
    return _spans(text, detectors.addresses(F.col("text"), SHIPPED))


def structured_ids(spark, sf_dir):
    spaced = lambda c: F.concat(F.substring(c, 1, 6), F.lit(" "), F.substring(c, 7, 30))
    text = F.concat(F.lit("ИНН "), spaced(F.col("inn")), F.lit("; ОГРН "), spaced(F.col("ogrn")), F.lit("; КПП "), spaced(F.col("kpp")), F.lit("; счет "), spaced(F.col("rs")), F.lit("."))
    found = F.concat(*[structured.recognised(F.col("text"), r) for r in structured.IDENTIFIERS])
    return _spans(contracts(spark, sf_dir).select("doc_id", text.alias("text")), found)


def _anonymized(style: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: structured.anonymize_contacts(documents(spark, sf_dir), style, settings=structured.Settings())


def stop_fragment(spark, sf_dir):
    words = F.split(F.col("c_mktsegment"), "x")
    n = F.col("c_custkey")
    part = lambda k, a, b: F.when(n % k == 0, a).otherwise(b)
    text = F.concat(part(2, "договор", "Иванов"), F.lit(" "), part(3, "Сторона", "Пётр"), F.lit(" "), part(5, "123", F.lower(words[0])))
    return read(spark, sf_dir, "customer").select(n.alias("doc_id"), text.alias("fragment")).withColumn("stop", names.stop_fragment(F.col("fragment")))


def overlap_anti(spark, sf_dir):
    """Lines of an order that are not near an earlier line of it."""
    grouped = _line_spans(spark, sf_dir, merged_too=False)
    alone = F.filter("spans", lambda s: ~F.exists("spans", lambda p: (p["ord"] < s["ord"]) & similar(s, p)))
    return grouped.select("doc_id", F.explode(alone).alias("s")).select("doc_id", "s.ord", "s.start", "s.end")


# --- text and offsets ---------------------------------------------------------------------------------------------------------------------


def normalize_text(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", normalized(F.col("text")).alias("norm"))


def offset_map(spark, sf_dir):
    """Where the last word of each contract stands, in normalised and in given text."""
    df = contracts(spark, sf_dir).withColumn("norm", normalized(F.col("text"))).withColumn("norm_at", F.length("norm") - 5)
    at = original(F.col("norm_at"), edits(F.col("text")))
    return df.select("doc_id", "norm_at", at.alias("text_at"), F.col("text").substr(at + 1, F.lit(5)).alias("word"))


# --- merging ------------------------------------------------------------------------------------------------------------------------------


def _line_spans(spark, sf_dir, merged_too: bool = True) -> DataFrame:
    lines = _sql(spark, sf_dir, LINE_SPANS, "lineitem")
    one = span(F.col("first"), F.col("last"), F.col("label"), F.col("score")).withField("source", F.col("source")).withField("ord", F.col("ord").cast("int"))
    grouped = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))  # at most seven lines an order
    return grouped.withColumn("spans", merged(F.col("spans"))) if merged_too else grouped


def merge_spans(spark, sf_dir):
    return _line_spans(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")


def merge_spans_label(spark, sf_dir):
    return _line_spans(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.score", "s.source", "s.labels_joined")


def min_score_filter(spark, sf_dir):
    kept = scored(F.col("spans"), 0.75)
    return _line_spans(spark, sf_dir).select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.start", "s.end", "s.score")


# --- masks and reports --------------------------------------------------------------------------------------------------------------------


def _masked(style: MaskStyle, keep_length: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        found = detectors.emails(F.col("text"), SHIPPED)
        df = documents(spark, sf_dir).withColumn("spans", found)
        return df.select("doc_id", masked(F.col("text"), F.col("spans"), Options(style, keep_length), F.col("doc_id"), salt="")["redacted"].alias("redacted"))

    return query


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document through the whole pipeline."""
    out = redact(spread(documents(spark, sf_dir)), SHIPPED, key="doc_id")
    return out.select("doc_id", "redacted", F.size("logs").cast("bigint").alias("n_masked"))


def _contract_logs(spark, sf_dir) -> DataFrame:
    return redact(spread(contracts(spark, sf_dir).select("doc_id", "text")), SHIPPED, Options(), key="doc_id")


def redaction_log(spark, sf_dir):
    return summary.logs(_contract_logs(spark, sf_dir)).select("doc_id", "label", "start", "end", "substr", "before_hash", "after")


def summary_by_label(spark, sf_dir):
    return summary.by_label(_contract_logs(spark, sf_dir))


def chars_masked_per_document(spark, sf_dir):
    out = redact(spread(documents(spark, sf_dir)), SHIPPED)
    done = summary.per_document(out)
    entry = lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    return done.select("doc_id", "status", F.array_join(F.transform(F.map_entries("replacements"), entry), ",").alias("replacements"), "chars_masked")


def summary_totals(spark, sf_dir):
    return summary.totals(summary.per_document(_contract_logs(spark, sf_dir)))


def redact_contracts(spark, sf_dir):
    return _contract_logs(spark, sf_dir).select("doc_id", "redacted")


def redact_text_column(spark, sf_dir):
    done = redact_text(F.col("text"), SHIPPED)
    return spread(documents(spark, sf_dir)).select("doc_id", done.alias("done")).select("doc_id", "done.redacted")


def redact_all_recognisers(spark, sf_dir):
    """Contracts through recognisers, the name rules and patterns together."""
    options = Options(recognizers=("structured", "ner", "regex"))
    signed = F.concat(F.col("text"), F.lit(" Подписал: Иванов И.И."))
    out = redact(spread(contracts(spark, sf_dir).select("doc_id", signed.alias("text"))), SHIPPED, options)
    return summary.logs(out).select("doc_id", "label", "start", "end", "score", "source")


def person_names(spark, sf_dir):
    text = F.concat(F.lit("Договор подписал Иванов И.И. и Петрова Анна Ивановна, "), F.col("doc_id").cast("string"))
    df = contracts(spark, sf_dir).select("doc_id", text.alias("text")).withColumn("spans", F.concat(*names.name_spans(F.col("text"), required=True)))
    return _spans(df, F.col("spans"))


def sql_redact(spark, sf_dir):
    sql.register(spark, SHIPPED, names=["redact"])
    return spark.sql("SELECT doc_id, redact(text) AS redacted FROM {documents}", documents=spread(documents(spark, sf_dir)))


def sql_redact_contracts(spark, sf_dir):
    sql.register(spark, SHIPPED, names=["redact"])
    return spark.sql("SELECT doc_id, redact(text) AS redacted FROM {contracts}", contracts=spread(contracts(spark, sf_dir).select("doc_id", "text")))


def sql_detect_spans(spark, sf_dir):
    sql.register(spark, SHIPPED, names=["detect_spans"])
    return spark.sql("SELECT doc_id, s.label, s.start, s.end, s.value FROM {documents}, LATERAL detect_spans(text) AS s", documents=documents(spark, sf_dir))


def stream_redact(spark, sf_dir):
    from ..streaming.redact import redact_available

    return redact_available(spark, f"{sf_dir}/documents.parquet", SHIPPED)


# --- files --------------------------------------------------------------------------------------------------------------------------------


def _work(spark: SparkSession) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/files-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return store.makeQualified(path).toString()


def _letters(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """A file name and a text with an e-mail address for each nation."""
    name = F.concat(F.lit(f"{root}/"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit(".txt"))
    text = F.concat(F.lit("Пишите: "), F.col("n_name"), F.lit("\nu@x.example.com"))
    return read(spark, sf_dir, "nation").select(name.alias("doc_id"), text.alias("redacted"))


def _files(df: DataFrame, root: str, *more: str) -> DataFrame:
    return df.select(F.substring("doc_id", len(root) + 2, 10_000).alias("file"), *more)


def files_text(spark, sf_dir):
    """Text files written, found and read in folders, redacted, written beside them in like folders, and read again."""
    root = _work(spark)
    letters, out = f"{root}/in", f"{root}/out"
    sinks.write_texts(_letters(spark, sf_dir, root), root, letters)
    sinks.write_texts(redact(files.read_documents(spark, letters, recursive=True), SHIPPED), letters, out)
    return _files(files.read_documents(spark, out, recursive=True), out, "text")


def files_flat(spark, sf_dir):
    """Without folders below: a file beside folders is found, files in them are not."""
    root = _work(spark)
    sinks.write_texts(_letters(spark, sf_dir, root), root, root)
    return _files(files.read_documents(spark, f"{root}/2"), f"{root}/2", "text")


def files_logs(spark, sf_dir):
    """JSON lines of what was masked in files."""
    root = _work(spark)
    sinks.write_texts(_letters(spark, sf_dir, root), root, f"{root}/in")
    sinks.write_logs(redact(files.read_documents(spark, f"{root}/in", recursive=True), SHIPPED), f"{root}/log")
    logged = spark.read.schema("file string, label string, start int, end int, after string").json(f"{root}/log")
    return _files(logged.withColumnRenamed("file", "doc_id"), f"{root}/in", "label", "start", "end", "after")


def files_word(spark, sf_dir):
    """Word files of the regions: a paragraph a line."""
    root, jvm = _work(spark), spark.sparkContext._jvm
    for row in read(spark, sf_dir, "region").collect():  # five files
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as word:
            lines = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in ("Регион", row["r_name"]))
            word.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/r{row['r_regionkey']}.docx")
        stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        stream.write(bytearray(held.getvalue()))
        stream.close()
    return _files(files.read_documents(spark, root), root, "text")


# --- SQL of the same results --------------------------------------------------------------------------------------------------------------

_EMAIL = r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_URL = r"(?i)(?:(?:https?|ftp)://)?(?:www\.)?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]*)?"
_NORM = "regexp_replace(translate(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(\\p{L})-\\n(\\p{L})', '\\1\\2', 'g'), '«»”„—–−', '\"\"\"\"---'), '', '')"


def _oracle_matches(rx: str, label: str, source: str = "SELECT doc_id, text FROM documents", good: str = "true") -> str:
    """All matches with their offsets, from the lengths of pieces and matches."""
    return f"""
    WITH cut AS (SELECT doc_id, regexp_split_to_array(text, '{rx}') AS g, regexp_extract_all(text, '{rx}') AS m FROM ({source}) AS t WHERE regexp_matches(text, '{rx}')),
    each AS (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM cut),
    placed AS (SELECT doc_id, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS start FROM each)
    SELECT doc_id, '{label}' AS label, start, CAST(start + length(value) AS INT) AS "end", value FROM placed WHERE {good}"""


def _norm_contracts(columns: str = "doc_id, text") -> str:
    return f"SELECT doc_id, {_NORM} AS text FROM ({CONTRACTS}) AS k"


def _oracle_place(label: str, value: str, good: str = "true") -> str:
    """A value that stands once in each contract."""
    at = f"strpos(norm, {value}) - 1"
    return f"""SELECT doc_id, '{label}' AS label, CAST({at} AS INT) AS start, CAST({at} + length({value}) AS INT) AS "end", {value} AS value FROM (SELECT *, {_NORM} AS norm FROM ({CONTRACTS}) AS k) AS q WHERE {good}"""


def _spaced(column: str) -> str:
    return f"concat(substr({column}, 1, 6), ' ', substr({column}, 7))"


def _oracle_masked(mask: str) -> str:
    return f"""
    WITH cut AS (SELECT doc_id, regexp_split_to_array(text, '{_EMAIL}') AS g, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)
    SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(m) THEN {mask.replace("?", "m[i]")} ELSE '' END), '') AS redacted FROM cut"""


_FOLD = """
    WITH lines AS ({spans}),
    grouped AS (SELECT doc_id, list({{'start': first, 'end': last, 'label': label, 'score': score, 'source': source, 'labels_joined': NULL::VARCHAR,
        'rank': CASE source WHEN 'Regex' THEN 3 WHEN 'Presidio Custom' THEN 2 WHEN 'Natasha' THEN 1 ELSE 0 END}} ORDER BY first, last DESC, ord, label, score, source) AS s FROM lines GROUP BY doc_id),
    single AS (SELECT doc_id, list_transform(s, lambda x: [x]) AS s FROM grouped),
    folded AS (SELECT doc_id, list_reduce(s, lambda acc, x: CASE
        WHEN acc[-1]."end" > x[1].start AND x[1]."end" > acc[-1].start THEN acc[1:-2] || [{{
            'start': least(acc[-1].start, x[1].start), 'end': greatest(acc[-1]."end", x[1]."end"),
            'label': CASE WHEN {wins} THEN x[1].label ELSE acc[-1].label END, 'score': CASE WHEN {wins} THEN x[1].score ELSE acc[-1].score END,
            'source': CASE WHEN {wins} THEN x[1].source ELSE acc[-1].source END,
            'labels_joined': CASE WHEN (acc[-1].label = 'ROLE' AND x[1].label = 'PERSON') OR (acc[-1].label = 'PERSON' AND x[1].label = 'ROLE') THEN 'ROLE+PERSON' END,
            'rank': CASE WHEN {wins} THEN x[1].rank ELSE acc[-1].rank END}}]
        ELSE acc || x END) AS s FROM single),
    every AS (SELECT doc_id, unnest(s) AS s FROM folded)
    SELECT doc_id, s.start AS start, s."end" AS "end"{more} FROM every{where}"""
_WINS = """(CASE WHEN abs(x[1].score - acc[-1].score) > 1e-9 THEN x[1].score > acc[-1].score WHEN x[1].rank <> acc[-1].rank THEN x[1].rank > acc[-1].rank
        ELSE x[1]."end" - x[1].start > acc[-1]."end" - acc[-1].start END)"""


def _fold(more: str, where: str = "") -> str:
    return _FOLD.format(spans=LINE_SPANS, wins=_WINS, more=more, where=where)


_LOGGED = {"INN": "inn", "INN12": "inn12", "OGRN": "ogrn", "KPP": "kpp", "RS": "rs", "EMAIL": "mail", "ROLE": "poa", "DATE": "poa_date"}


#: The organisation at the head of each contract.
_ORG = "'ООО «Звезда ' || doc_id || '»'"


def _oracle_log() -> str:
    """What stands where in each contract; the place in the given text, as nothing is deleted before it."""
    parts = []
    for key, column in _LOGGED.items():
        label = {"INN12": "INN", "DATE": "ROLE"}.get(key, key)
        good = {"INN": "inn_ok", "INN12": "inn12_ok", "OGRN": "ogrn_ok"}.get(key, "true")
        head = "КПП " if key == "KPP" else " "  # an INN begins like its KPP
        parts.append(f"SELECT doc_id, '{label}' AS label, strpos(text, '{head}' || {column}) + {len(head) - 1} AS place, {column} AS substr FROM k WHERE {good}")
    parts += ["SELECT doc_id, 'ROLE', strpos(text, 'в лице д') - 1, 'в лице д' FROM k", f"SELECT doc_id, 'ORG', 0, {_ORG} FROM k"]
    return f"""
    WITH k AS ({CONTRACTS}), found AS ({" UNION ALL ".join(parts)})
    SELECT doc_id, label, CAST(place AS INT) AS start, CAST(place + length(substr) AS INT) AS "end", substr, sha256(substr) AS before_hash, '[[ENTITY:' || label || ']]' AS after FROM found"""


def _oracle_recognised() -> str:
    """Each contract's spans with the score and source that win; an identifier of separated digits takes the blank behind its last digit, too."""
    own, default = "1.0, 'Presidio Custom'", "1.0, 'Presidio Default'"
    values = [("INN", "' ' || inn", 1, "inn || ' '", own, "inn_ok"), ("INN", "' ' || inn12", 1, "inn12", own, "inn12_ok"), ("OGRN", "' ' || ogrn", 1, "ogrn", own, "ogrn_ok"), ("KPP", "'КПП ' || kpp", 4, "kpp", own, "true")]
    values += [("RS", "rs", 0, "rs", own, "true"), ("EMAIL_ADDRESS", "mail", 0, "mail", default, "true"), ("ROLE", "'в лице д'", 0, "'в лице д'", "0.92, 'Regex'", "true"), ("ROLE", "' ' || poa", 1, "poa", "0.97, 'Regex'", "true")]
    values += [("ROLE", "poa_date", 0, "poa_date", "0.97, 'Regex'", "true"), ("ORG", _ORG, 0, _ORG, "0.85, 'Regex'", "true"), ("PERSON", "'Иванов И.И.'", 0, "'Иванов И.И.'", "0.75, 'Natasha'", "true")]
    parts = [f"SELECT doc_id, '{label}' AS label, strpos(signed, {head}) - 1 + {skip} AS place, length({value}) AS size, {scored_by} FROM k WHERE {good}" for label, head, skip, value, scored_by, good in values]
    return f"""
    WITH k AS (SELECT *, text || ' Подписал: Иванов И.И.' AS signed FROM ({CONTRACTS}) AS c), found(doc_id, label, place, size, score, source) AS ({" UNION ALL ".join(parts)})
    SELECT doc_id, label, CAST(place AS INT) AS start, CAST(place + size AS INT) AS "end", CAST(score AS DOUBLE) AS score, source FROM found"""


def _oracle_random() -> str:
    """E-mails under random masks: letters by the digest of the seed, the document and the place."""
    return f"""
    WITH cut AS (SELECT doc_id, regexp_split_to_array(text, '{_EMAIL}') AS g, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents),
    placed AS (SELECT doc_id, g, m, list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT)) AS places FROM cut),
    coded AS (SELECT doc_id, g, m, list_transform(places, lambda x: sha256('{SEED}:' || doc_id || ':' || x)) AS code FROM placed),
    drawn AS (SELECT doc_id, g, m, list_transform(range(1, len(m) + 1), lambda i: array_to_string(list_transform(range(least(greatest(length(m[i]), {SHORTEST}), {LONGEST})),
        lambda j: substr('{ALPHABET}', CAST('0x' || substr(code[i], 2 * j + 1, 2) AS INT) % {len(ALPHABET)} + 1, 1)), '')) AS r FROM coded)
    SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(m) THEN r[i] ELSE '' END), '') AS redacted FROM drawn"""


#: Contacts; what may not stand beside a telephone number is a group of its own here.
_CONTACT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_NUMBER = r"(^|[^0-9.\x01])((?:\+[0-9]{1,3}|8)[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2})($|[^0-9])"


def _oracle_contacts(mail: str, number: str) -> str:
    """Contacts between chr(1) or chr(3) and chr(2), then replaced. Numbers that share the sign between them take a second turn."""
    framed = f"regexp_replace(text, '({_CONTACT})', chr(3) || '\\1' || chr(2), 'g')"
    for _ in range(2):
        framed = f"regexp_replace({framed}, '{_NUMBER}', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    piece = "CASE WHEN strpos(x, chr(2)) = 0 THEN x ELSE {} || substr(x, strpos(x, chr(2)) + 1) END"
    inside = "substr(x, 2, strpos(x, chr(2)) - 2)"
    pick = f"CASE WHEN x[1] = chr(3) THEN {mail.format(inside)} ELSE {number.format(inside)} END"
    cut = "string_split(replace(replace(framed, chr(1), chr(4) || chr(1)), chr(3), chr(4) || chr(3)), chr(4))"
    return f"SELECT doc_id, array_to_string(list_transform({cut}, lambda x: {piece.format(pick)}), '') AS text FROM (SELECT doc_id, {framed} AS framed FROM documents) AS f"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        validate_inn10, validate_inn12, validate_ogrn, validate_lengths, detect_email, detect_url, detect_org, detect_role, subject_header, subject_keyword, detect_address,
        structured_ids, stop_fragment, overlap_anti, normalize_text, offset_map, merge_spans, merge_spans_label, min_score_filter, redact_documents,
        redaction_log, summary_by_label, chars_masked_per_document, summary_totals, redact_contracts, stream_redact,
        redact_text_column, redact_all_recognisers, person_names, sql_redact, sql_redact_contracts, sql_detect_spans, files_text, files_flat, files_logs, files_word,
    )
    found = {f.__name__: f for f in plain}
    found |= {"anonymize_contacts": _anonymized("tag"), "anonymize_contacts_mask": _anonymized("mask"), "anonymize_contacts_hash": _anonymized("hash")}
    found |= {f"detect_{label.lower()}": _detected_id(label) for label in detectors.DIGITS}
    found |= {f"mask_{style.value}": _masked(style) for style in MaskStyle} | {"mask_keep_length": _masked(MaskStyle.TAG, True)}
    return found


def oracle_sql() -> dict[str, str]:
    ok = lambda value, good: f"SELECT doc_id, {value}, {good} AS valid FROM ({CONTRACTS}) AS k"
    lengths = {"kpp": 9, "rs": 20, "inn": 10}
    checks = ", ".join(f"length({c}) = {n} AS {c}_{k}" for c in lengths for k, n in validators.LENGTHS.items())
    tail = "strpos(norm, 'Исполнитель') - 1"
    paragraph = f"""SELECT doc_id, 'SUBJECT' AS label, CAST({tail} AS INT) AS start, CAST(strpos(norm, 'конец.') + 5 AS INT) AS "end", substr(norm, {tail} + 1, strpos(norm, 'конец.') + 5 - ({tail})) AS value FROM (SELECT *, {_NORM} AS norm FROM ({CONTRACTS}) AS k) AS q"""
    head = f"strpos(norm, '{PLAIN_HEADER}') - 1 - back"
    section = f"""SELECT doc_id, 'SUBJECT' AS label, CAST({head} AS INT) AS start, CAST(strpos(norm, '1. СТОРОНЫ') - 1 AS INT) AS "end", substr(norm, {head} + 1, strpos(norm, '1. СТОРОНЫ') - 1 - ({head})) AS value FROM (SELECT *, {_NORM} AS norm, 1 AS back FROM ({CONTRACTS}) AS k) AS q"""
    masked_text = f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_EMAIL}', '[[ENTITY:EMAIL]]', 'g'), '{_URL}', '[[ENTITY:URL]]', 'g') AS redacted FROM documents"
    emails_blanked = f"SELECT doc_id, regexp_replace(text, '{_EMAIL}', ' ', 'g') AS text FROM documents"  # no URL stands beside an e-mail here
    found = {
        "validate_inn10": ok("inn", "inn_ok"),
        "validate_inn12": ok("inn12", "inn12_ok"),
        "validate_ogrn": ok("ogrn", "ogrn_ok"),
        "validate_lengths": f"SELECT doc_id, {checks} FROM ({CONTRACTS}) AS k",
        "detect_email": _oracle_matches(_EMAIL, "EMAIL"),
        "detect_url": _oracle_matches(_URL, "URL", "SELECT page_id AS doc_id, html AS text FROM pages"),
        "detect_inn": _oracle_place("INN", "inn", "inn_ok") + " UNION ALL " + _oracle_place("INN", "inn12", "inn12_ok"),
        "detect_ogrn": _oracle_place("OGRN", "ogrn", "ogrn_ok"),
        "detect_kpp": _oracle_matches(r"\b[0-9]{9}\b", "KPP", _norm_contracts()),
        "detect_bik": _oracle_matches(r"\b[0-9]{9}\b", "BIK", _norm_contracts()),
        "detect_rs": _oracle_matches(r"\b[0-9]{20}\b", "RS", _norm_contracts()),
        "detect_ks": _oracle_matches(r"\b[0-9]{20}\b", "KS", _norm_contracts()),
        "detect_org": _oracle_matches(r'ООО "[^"\n]{1,200}"', "ORG", _norm_contracts()),
        "detect_role": " UNION ALL ".join((_oracle_place("ROLE", "'в лице д'"), _oracle_place("ROLE", "poa"), _oracle_place("ROLE", "poa_date"))),
        "subject_keyword": paragraph,
        "subject_header": section,
        "normalize_text": f"SELECT doc_id, {_NORM} AS norm FROM ({CONTRACTS}) AS k",
        "offset_map": f"SELECT doc_id, CAST(length({_NORM}) - 5 AS INT) AS norm_at, CAST(length(text) - 5 AS INT) AS text_at, 'Конец' AS word FROM ({CONTRACTS}) AS k",
        "merge_spans": f"""
            WITH lines AS ({LINE_SPANS}), seen AS (SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lines),
            islands AS (SELECT *, sum(CASE WHEN reach > first THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY first, last DESC, ord) AS island FROM seen)
            SELECT doc_id, min(first) AS start, max(last) AS "end" FROM islands GROUP BY doc_id, island""",
        "merge_spans_label": _fold(", s.label AS label, s.score AS score, s.source AS source, s.labels_joined AS labels_joined"),
        "min_score_filter": _fold(", s.score AS score", " WHERE s.score >= 0.75"),
        "overlap_anti": f"""
            WITH lines AS ({LINE_SPANS})
            SELECT doc_id, ord, first AS start, last AS "end" FROM lines AS a WHERE NOT EXISTS (SELECT 1 FROM lines AS b WHERE a.doc_id = b.doc_id AND b.ord < a.ord AND (
                (a.first <= b.first AND a.last >= b.last) OR (b.first <= a.first AND b.last >= a.last)
                OR (least(a.last, b.last) > greatest(a.first, b.first) AND 2 * (least(a.last, b.last) - greatest(a.first, b.first)) >= a.last - a.first + b.last - b.first - (least(a.last, b.last) - greatest(a.first, b.first)))))""",
        "stop_fragment": """
            WITH parts AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'договор' ELSE 'Иванов' END AS a, CASE WHEN c_custkey % 3 = 0 THEN 'Сторона' ELSE 'Пётр' END AS b,
                CASE WHEN c_custkey % 5 = 0 THEN '123' ELSE lower(string_split(c_mktsegment, 'x')[1]) END AS c FROM customer)
            SELECT doc_id, concat(a, ' ', b, ' ', c) AS fragment, (a = 'договор' AND b = 'Сторона' AND c = '123') OR (c = '123' AND (a = 'договор' OR b = 'Сторона')) AS stop FROM parts""",
        "structured_ids": f"""
            WITH k AS (SELECT *, {_spaced("inn")} AS inn_s, {_spaced("ogrn")} AS ogrn_s, {_spaced("kpp")} AS kpp_s, {_spaced("rs")} AS rs_s FROM ({CONTRACTS}) AS c),
            lines AS (SELECT *, concat('ИНН ', inn_s, '; ОГРН ', ogrn_s, '; КПП ', kpp_s, '; счет ', rs_s, '.') AS line FROM k),
            found AS (SELECT doc_id, line, 'INN' AS label, 'ИНН ' AS head, inn_s AS value FROM lines WHERE inn_ok UNION ALL SELECT doc_id, line, 'OGRN', 'ОГРН ', ogrn_s FROM lines WHERE ogrn_ok
                UNION ALL SELECT doc_id, line, unnest(['KPP', 'BIK']), 'КПП ', kpp_s FROM lines UNION ALL SELECT doc_id, line, unnest(['RS', 'KS']), 'счет ', rs_s FROM lines),
            placed AS (SELECT *, strpos(line, concat(head, value)) - 1 + length(head) AS place FROM found)
            SELECT doc_id, label, CAST(place AS INT) AS start, CAST(place + length(value) AS INT) AS "end", value FROM placed""",
        "anonymize_contacts": _oracle_contacts("'[[ENTITY:EMAIL]]'", "'[[ENTITY:PHONE]]'"),
        "anonymize_contacts_mask": _oracle_contacts("repeat('*', length({}))", "repeat('*', length({}))"),
        "anonymize_contacts_hash": _oracle_contacts("sha256({})", "sha256({})"),
        "detect_address": f"""SELECT doc_id, 'ADDR' AS label, 0 AS start, CAST(strpos(text, 'этаж 2.') + 6 AS INT) AS "end", substr(text, 1, strpos(text, 'этаж 2.') + 6) AS value
            FROM (SELECT n AS doc_id, {ADDRESS} AS text FROM (SELECT c_custkey AS n FROM customer) AS c) AS a""",
        "redact_all_recognisers": _oracle_recognised(),
        "files_text": "SELECT concat(n_regionkey, '/n', n_nationkey, '.txt') AS file, concat('Пишите: ', n_name, chr(10), '[[ENTITY:EMAIL]]') AS text FROM nation",
        "files_flat": "SELECT concat('n', n_nationkey, '.txt') AS file, concat('Пишите: ', n_name, chr(10), 'u@x.example.com') AS text FROM nation WHERE n_regionkey = 2",
        "files_logs": """SELECT concat(n_regionkey, '/n', n_nationkey, '.txt') AS file, 'EMAIL' AS label, CAST(length(n_name) + 9 AS INT) AS start, CAST(length(n_name) + 24 AS INT) AS "end", '[[ENTITY:EMAIL]]' AS after FROM nation""",
        "files_word": "SELECT concat('r', r_regionkey, '.docx') AS file, concat('Регион', chr(10), r_name) AS text FROM region",
        "mask_random": _oracle_random(),
        "mask_tag": _oracle_masked("'[[ENTITY:EMAIL]]'"),
        "mask_hash": _oracle_masked("substr(sha256(?), 1, 12)"),
        "mask_asterisks": _oracle_masked("repeat('*', length(?))"),
        "mask_keep_length": _oracle_masked("rpad('[[ENTITY:EMAIL]]', CAST(length(?) AS INT), '*')"),
        "redact_documents": f"""
            SELECT doc_id, regexp_replace(mailed, '{_URL}', '[[ENTITY:URL]]', 'g') AS redacted, CAST(len(regexp_extract_all(text, '{_EMAIL}')) + len(regexp_extract_all(mailed, '{_URL}')) AS BIGINT) AS n_masked
            FROM (SELECT doc_id, text, regexp_replace(text, '{_EMAIL}', '[[ENTITY:EMAIL]]', 'g') AS mailed FROM documents) AS t""",
        "redact_text_column": masked_text,
        "sql_redact": masked_text,
        "stream_redact": masked_text,
        "sql_detect_spans": f"SELECT * FROM ({_oracle_matches(_EMAIL, 'EMAIL')}) AS m UNION ALL SELECT * FROM ({_oracle_matches(_URL, 'URL', emails_blanked)}) AS u",
        "person_names": """
            WITH t AS (SELECT c_custkey AS doc_id, unnest(['Иванов И.И.', 'Петрова Анна Ивановна']) AS value FROM customer)
            SELECT doc_id, 'PERSON' AS label, CAST(strpos('Договор подписал Иванов И.И. и Петрова Анна Ивановна, ', value) - 1 AS INT) AS start, CAST(strpos('Договор подписал Иванов И.И. и Петрова Анна Ивановна, ', value) - 1 + length(value) AS INT) AS "end", value FROM t""",
        "redact_contracts": f"""
            SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, 'ООО «Звезда ' || doc_id || '»', '[[ENTITY:ORG]]'), 'КПП ' || kpp, 'КПП [[ENTITY:KPP]]'), CASE WHEN inn_ok THEN inn ELSE '?' END, '[[ENTITY:INN]]'),
                CASE WHEN inn12_ok THEN inn12 ELSE '?' END, '[[ENTITY:INN]]'), CASE WHEN ogrn_ok THEN ' ' || ogrn ELSE '?' END, ' [[ENTITY:OGRN]]'), rs, '[[ENTITY:RS]]'), mail, '[[ENTITY:EMAIL]]'), 'в лице д', '[[ENTITY:ROLE]]'),
                poa || ' от ' || poa_date, '[[ENTITY:ROLE]] от [[ENTITY:ROLE]]') AS redacted FROM ({CONTRACTS}) AS k""",
        "redaction_log": _oracle_log(),
        "summary_by_label": f"SELECT label, count(*) AS n FROM ({_oracle_log()}) AS l GROUP BY label",
        "chars_masked_per_document": f"""
            SELECT doc_id, 'ok' AS status, concat_ws(',', CASE WHEN len(m) > 0 THEN 'EMAIL=' || len(m) END, CASE WHEN len(u) > 0 THEN 'URL=' || len(u) END) AS replacements, CAST(coalesce(list_sum(list_transform(m, lambda x: length(x))), 0) + coalesce(list_sum(list_transform(u, lambda x: length(x))), 0) AS BIGINT) AS chars_masked
            FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS m, regexp_extract_all(regexp_replace(text, '{_EMAIL}', ' ', 'g'), '{_URL}') AS u FROM documents) AS t""",
        "summary_totals": f"""
            SELECT (SELECT count(*) FROM customer) AS files, (SELECT count(*) FROM customer) AS ok,
                CAST((SELECT sum("end" - start) FROM ({_oracle_log()}) AS l) AS BIGINT) AS chars_masked""",
    }
    found["sql_redact_contracts"] = found["redact_contracts"]
    return found
