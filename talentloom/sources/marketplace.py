"""Sources: Parquet or JDBC tables, résumé files, and the marketplace seen in star-schema tables."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.sources.pdf import Pdf
from talentloom.sources.schemas import SCHEMAS

# Limits of uploaded files.
MOST_MEMBERS, MOST_UNZIPPED, MOST_RATIO, MOST_UPLOAD = 1000, 20 << 20, 100, 5 << 20
SKILL_POOL = ("python", "sql", "docker", "aws", "react", "java", "git", "linux")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A marketplace table kept as Parquet, under its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def jdbc_url(url: str) -> str:
    """An application's database address as JDBC writes it: without the name of a Python driver."""
    return re.sub(r"^(jdbc:)?(mysql|postgresql)(\+\w+)?://", r"jdbc:\2://", url)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str = "id", bounds: tuple[int, int] | None = None, parts: int = 32, options: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC, read in ``parts`` equal ranges of its key if bounds are given. Filters and columns are pushed down."""
    reader = spark.read.format("jdbc").option("url", jdbc_url(url)).option("dbtable", name).options(**(options or {}))
    if bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def even_ranges(key: str, quantiles: list[float]) -> list[str]:
    """Conditions that part a table at the quantiles of its key: each row, also one without a key, meets exactly one."""
    at = sorted({int(q) for q in quantiles})
    if not at:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(at[:-1], at[1:], strict=True)]
    return [f"{key} < {at[0]} OR {key} IS NULL", *inner, f"{key} >= {at[-1]}"]


def read_jdbc_evenly(spark: SparkSession, url: str, name: str, key: str = "id", parts: int = 32, error: float = 0.001, options: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC in ``parts`` ranges of about as many rows each, however unevenly its keys lie.

    Equal ranges of a key with gaps make one task read nearly all rows. A first pass reads the key column alone, in equal ranges,
    and sketches its quantiles (to within ``error`` of the rows); the second reads the table between them.
    """
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc_url(url)).quoteIdentifier(key)  # as the database quotes names
    ends = spark.read.format("jdbc").option("url", jdbc_url(url)).option("query", f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {name}").options(**(options or {})).load().first()
    if ends[0] is None:
        return read_jdbc(spark, url, name, options=options)
    keys = read_jdbc(spark, url, name, key, (int(ends[0]), int(ends[1]) + 1), parts, options).select(F.col(key).cast("double").alias(key))
    quantiles = keys.approxQuantile(key, [k / parts for k in range(1, parts)], error)
    return spark.read.jdbc(jdbc_url(url), name, predicates=even_ranges(quoted, quantiles), properties=dict(options or {}))


def health(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 1 AS ok")


def find(df: DataFrame, key: int, column: str = "id") -> DataFrame:
    """Point lookup."""
    return df.filter(F.col(column) == key).limit(1)


def file_problem(name: str, data: bytes) -> str | None:
    """Why an uploaded file is refused, or None."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in ("pdf", "docx"):
        return "unsupported type"
    if not data:
        return "empty"
    if len(data) > MOST_UPLOAD:
        return "too large"
    if kind == "pdf":
        return None if data.startswith(b"%PDF") else "not a PDF"
    try:
        members = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, ValueError, OverflowError, EOFError, NotImplementedError):
        return "not a DOCX"
    if not {"[Content_Types].xml", "word/document.xml"} <= {m.filename for m in members}:
        return "not a DOCX"
    size, packed = sum(m.file_size for m in members), sum(m.compress_size for m in members)
    if len(members) > MOST_MEMBERS or size > MOST_UNZIPPED or size > MOST_RATIO * max(packed, 1):
        return "unsafe archive"
    return None


def stored_name(original: str):
    """A file's name in the store: a random one with the original's ending."""
    return F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit("."), F.lower(F.element_at(F.split(original, r"\."), -1)))


def docx_text(data: bytes) -> str:
    """Non-empty paragraphs of the body, joined by line ends."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    lines = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in (body if body is not None else []) if p.tag == f"{w}p")
    return "\n".join(x for x in lines if x)


def pdf_text(data: bytes) -> str:
    """The pages' texts, joined by line ends: by pypdf where it is installed, else by our own reader."""
    try:
        from pypdf import PdfReader
    except ModuleNotFoundError:
        return Pdf(data).text()
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def read_resume_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_type, extracted_text, error of each file below ``path``."""
    return resume_file_texts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def resume_file_texts(files: DataFrame) -> DataFrame:
    """path, file_type, extracted_text, error of files (path, content). What can't be read has the reason, not a text."""

    def run(batches):
        for batch in batches:
            kinds, texts, errors = [], [], []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = name or ""
                error, text = file_problem(name, data), None
                kinds.append(name.rsplit(".", 1)[-1].lower())
                if error is None:
                    try:
                        text = pdf_text(data) if kinds[-1] == "pdf" else docx_text(data)
                    except Exception as e:  # whatever a broken file brings about stays in its row
                        error = f"unreadable: {e or type(e).__name__}"[:1000]
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "file_type", "extracted_text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, file_type string, extracted_text string, error string")


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, for a JSON sink."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


class StarSchema:
    """The marketplace's tables as views of customer, supplier, part, orders and lineitem."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def users(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.when(F.col("c_custkey") == 0, "Admin").when(F.col("c_custkey") < 25, "Employer").otherwise("Candidate").alias("role"))

    @property
    def profiles(self) -> DataFrame:
        """A profile for each customer with a balance."""
        rows = self.raw("customer").filter("c_acctbal > 0")
        return rows.select(F.col("c_custkey").alias("user_id"), F.concat(F.initcap("c_mktsegment"), F.lit(" specialist")).alias("headline"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("location"))

    @property
    def companies(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("location"), F.col("s_nationkey").cast("long").alias("owner_id"))

    @property
    def jobs(self) -> DataFrame:
        key = F.col("p_partkey")
        pick = lambda kind, n: F.element_at(F.array(*map(F.lit, kind)), (F.pmod(n, F.lit(len(kind))) + 1).cast("int"))
        return self.raw("part").select(
            key.alias("id"),
            F.col("p_name").alias("title"),
            F.concat_ws(" ", "p_type", "p_name", F.lit("for"), "p_brand").alias("description"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("salary"),
            F.col("p_brand").alias("location"),
            F.array_distinct(F.array(*(pick(SKILL_POOL, F.floor(key / d)) for d in (1, 3, 7)))).alias("skills"),
            pick(("Full-time", "Part-time", "Contract", "Internship"), F.col("p_size")).alias("employment_type"),
            pick(("Entry", "Junior", "Mid", "Senior"), F.floor(key / 5)).alias("experience_level"),
            pick(("Onsite", "Remote", "Hybrid"), key).alias("work_mode"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(p_partkey % 365 AS INT))").alias("posted_at"),
            F.pmod(key, F.lit(100)).alias("company_id"),
        )

    @property
    def applications(self) -> DataFrame:
        """One for each customer and part bought."""
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        status = F.when(F.max("l_returnflag") == "A", "Applied").when(F.max("l_returnflag") == "N", "Shortlisted").when(F.max("l_linestatus") == "F", "Rejected").otherwise("Withdrawn")
        grouped = both.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("job_id")).agg(status.alias("status"), F.min("l_shipdate").alias("applied_at"))
        return grouped.select((F.col("user_id") * 10_000_000 + F.col("job_id")).alias("id"), "user_id", "job_id", "status", "applied_at")

    @property
    def saved_jobs(self) -> DataFrame:
        """The parts a customer bought from a high-priority order."""
        lines, orders = self.raw("lineitem").select("l_orderkey", "l_partkey"), self.raw("orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey", "o_orderdate")
        both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        grouped = both.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("job_id")).agg(F.max("o_orderdate").alias("saved_at"))
        return grouped.select((F.col("user_id") * 10_000_000 + F.col("job_id")).alias("id"), "user_id", "job_id", "saved_at")

    @property
    def resumes(self) -> DataFrame:
        """An order is an upload; the first of a customer is the primary one."""
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("uploaded_at"), (F.col("o_orderstatus") == "F").alias("is_primary"))

    @property
    def status_log(self) -> DataFrame:
        """Events of a user as the log of one application."""
        status = F.element_at(F.create_map(*(F.lit(x) for p in (("signup", "Applied"), ("click", "Shortlisted"), ("purchase", "Selected"), ("error", "Rejected"), ("view", "Applied")) for x in p)), F.col("event_type"))
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("application_id"), status.alias("new_status"), F.col("ts").alias("changed_at"))


#: The same views in SQL.
STAR_SQL = """
WITH users AS (SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey = 0 THEN 'Admin' WHEN c_custkey < 25 THEN 'Employer' ELSE 'Candidate' END AS role FROM customer),
profiles AS (SELECT c_custkey AS user_id, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' specialist' AS headline, 'Nation ' || CAST(c_nationkey AS VARCHAR) AS location FROM customer WHERE c_acctbal > 0),
companies AS (SELECT s_suppkey AS id, s_name AS name, 'Nation ' || CAST(s_nationkey AS VARCHAR) AS location, CAST(s_nationkey AS BIGINT) AS owner_id FROM supplier),
jobs AS (SELECT p_partkey AS id, p_name AS title, p_type || ' ' || p_name || ' for ' || p_brand AS description, CAST(p_retailprice AS DECIMAL(10,2)) AS salary, p_brand AS location,
  list_sort(list_distinct([['python','sql','docker','aws','react','java','git','linux'][1 + p_partkey % 8], ['python','sql','docker','aws','react','java','git','linux'][1 + (p_partkey // 3) % 8], ['python','sql','docker','aws','react','java','git','linux'][1 + (p_partkey // 7) % 8]])) AS skills,
  ['Full-time','Part-time','Contract','Internship'][1 + p_size % 4] AS employment_type, ['Entry','Junior','Mid','Senior'][1 + (p_partkey // 5) % 4] AS experience_level, ['Onsite','Remote','Hybrid'][1 + p_partkey % 3] AS work_mode, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)) AS posted_at, p_partkey % 100 AS company_id FROM part),
applications AS (SELECT o_custkey * 10000000 + l_partkey AS id, o_custkey AS user_id, l_partkey AS job_id,
  CASE WHEN max(l_returnflag) = 'A' THEN 'Applied' WHEN max(l_returnflag) = 'N' THEN 'Shortlisted' WHEN max(l_linestatus) = 'F' THEN 'Rejected' ELSE 'Withdrawn' END AS status, min(l_shipdate) AS applied_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
saved_jobs AS (SELECT o_custkey * 10000000 + l_partkey AS id, o_custkey AS user_id, l_partkey AS job_id, max(o_orderdate) AS saved_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey, l_partkey),
resumes AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS uploaded_at, o_orderstatus = 'F' AS is_primary FROM orders),
status_log AS (SELECT event_id AS id, user_id AS application_id, CASE event_type WHEN 'click' THEN 'Shortlisted' WHEN 'purchase' THEN 'Selected' WHEN 'error' THEN 'Rejected' ELSE 'Applied' END AS new_status, ts AS changed_at FROM events)
"""
