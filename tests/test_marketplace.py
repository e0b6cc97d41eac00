"""Search, dashboards, state changes, parsing and sources; every query against its SQL."""

import datetime
import io
import zipfile
import zlib
from decimal import Decimal

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from talentloom.functions import text
from talentloom.operators import parsing, relational, writes
from talentloom.plans import queries
from talentloom.sources import marketplace, schemas
from talentloom.sources.pdf import Pdf
from talentloom.streaming import status_log

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    cell = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# ---- search


def test_pages_make_up_the_whole(spark):
    jobs = marketplace.StarSchema(spark, SF).jobs
    ordered = relational.sort(jobs, "salary", "desc", ("salary",))
    pages = [r.id for n in range(1, relational.total_pages(jobs.count(), 30) + 1) for r in relational.page(ordered, n, 30).collect()]
    assert pages == [r.id for r in ordered.collect()]
    assert relational.page(ordered, 99, 30).count() == 0 and relational.total_pages(0, 10) == 0
    with pytest.raises(ValueError):
        relational.page(ordered, 0, 30)


def test_blank_search_words_and_wrong_ranges(spark):
    jobs = marketplace.StarSchema(spark, SF).jobs
    assert relational.search_jobs(jobs, keyword="  ", location="", skill=" ").count() == jobs.count()
    with pytest.raises(ValueError):
        relational.search_jobs(jobs, min_salary=Decimal(2), max_salary=Decimal(1))
    assert "ilike" not in relational.search_jobs(jobs, company_id=1)._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_may_not_list_for_employers(spark):
    m = marketplace.StarSchema(spark, SF)
    with pytest.raises(PermissionError):
        relational.employer_applications(m.applications, m.jobs, m.companies, m.users, 1, "Candidate")
    every = relational.visible_applications(m.applications, m.jobs, m.companies, 1, "ADMIN")
    assert every.count() == m.applications.count()


# ---- state changes


def test_status_changes(spark):
    apps = spark.createDataFrame([(1, "Applied"), (2, "Shortlisted"), (3, "Rejected"), (4, "Applied")], "id long, status string")
    asked = [(1, "Shortlisted"), (2, "Selected"), (3, "Applied"), (4, "Applied"), (4, None), (9, "Applied")]
    requests = spark.createDataFrame([(i, s, 7, datetime.datetime(2024, 1, 1)) for i, s in asked], "id long, new_status string, changed_by long, changed_at timestamp_ntz")
    after, history, rejects = writes.change_status(apps, requests.filter("new_status IS NOT NULL"))
    assert {r.id: r.status for r in after.collect()} == {1: "Shortlisted", 2: "Selected", 3: "Rejected", 4: "Applied"}
    assert {(r.old_status, r.new_status) for r in history.collect()} == {("Applied", "Shortlisted"), ("Shortlisted", "Selected")}
    assert {r.id: r.reason for r in rejects.collect()} == {3: "not allowed", 4: "same status", 9: "no such application"}


def test_upsert_keeps_id_and_creation(spark):
    schema = "id long, resume_id long, job_id long, score int, created_at int, updated_at int"
    old = spark.createDataFrame([(1, 5, 6, 10, 100, 100)], schema)
    new = spark.createDataFrame([(8, 5, 6, 20, 200, 200), (9, 5, 6, 30, 300, 300), (10, 5, 7, 40, 200, 200)], schema)
    got = sorted(map(tuple, writes.upsert(old, new, ["resume_id", "job_id"]).collect()))
    assert got == [(1, 5, 6, 30, 100, 300), (10, 5, 7, 40, 200, 200)]


def test_upsert_query_replaces_rows(spark, monkeypatch):
    given, upsert = [], writes.upsert
    monkeypatch.setattr(writes, "upsert", lambda old, new, *a, **k: given.append((old, new)) or upsert(old, new, *a, **k))
    queries.QUERIES["upsert_latest_wins"](spark, SF)
    old, new = ({r[0] for r in df.select("application_id").collect()} for df in given[0])
    assert old & new and new - old


def test_insert_rejects_taken_and_repeated_keys(spark):
    old, new = spark.createDataFrame([(1, "a")], "id long, email string"), spark.createDataFrame([(2, "a"), (3, "b"), (4, "b")], "id long, email string")
    good, bad = writes.insert(old, new, ["email"])
    assert [r.id for r in good.collect()] == [3] and {r.id: r.reason for r in bad.collect()} == {2: "exists already", 4: "repeated in the batch"}


def test_checks_name_the_broken_rules(spark):
    rows = [(1, "Dev", "long enough text", Decimal("1.00"), ["a"], "Full-time", "Mid", "Remote"), (2, "D", "short", Decimal("-1.00"), [], "Sometimes", None, "Remote")]
    jobs = spark.createDataFrame(rows, "id long, title string, description string, salary decimal(10,2), skills array<string>, employment_type string, experience_level string, work_mode string")
    got = schemas.violations(jobs, "jobs").collect()
    assert [r.id for r in got] == [2] and set(got[0].broken) == {"title", "description", "salary", "skills", "employment_type", "experience_level"}


# ---- parsing

RESUME = """ANITA RAO Aspiring Backend Developer
anita.r@example.com | +91 9876543210 | LinkedIn: linkedin.com/in/anita | GitHub: [code](https://github.com/anita) github.com/anita

PROFESSIONAL SUMMARY
Backend developer with experience in building services and
learning new tools every day.

TECHNICAL SKILLS
Python • FastAPI • PostgreSQL, Docker

EXPERIENCE
Software Intern | Acme Labs | Remote 2022 - Present
• Built REST APIs with FastAPI
and deployed them.
• Wrote tests.

PROJECTS
Job Portal
Technologies: Python, FastAPI; React
• Implemented JWT authentication.
Chat Tool
• Used ChatGPT.

EDUCATION
Bachelor of Technology (CSE), ABC College, XYZ University
CGPA: 8.5
2019 - 2023

LANGUAGES
English, Hindi, english
"""


def test_resume(spark):
    docs = spark.createDataFrame([(1, RESUME), (2, "short"), (3, None), (4, RESUME.replace("\n", "\r\n"))], "doc_id long, text string")
    rows = {r.doc_id: r for r in parsing.parse_resumes(docs).collect()}
    d = rows[1].parsed_data
    assert (d.personal.name, d.personal.email, d.personal.phone) == ("ANITA RAO", "anita.r@example.com", "+91 9876543210")
    # an address counts only right behind its label
    assert (d.personal.linkedin, d.personal.github) == ("https://linkedin.com/in/anita", None)
    assert {"Python", "FastAPI", "PostgreSQL", "Docker", "React", "JWT"} <= set(d.skills) and d.ai_tools == ["ChatGPT"]
    e = d.experience[0]
    assert (e.title, e.company, e.organization, e.start_year, e.end_year) == ("Software Intern", "Acme Labs", "Remote", 2022, None)
    assert e.description == ["Built REST APIs with FastAPI and deployed them.", "Wrote tests."]
    assert [(p.name, p.technologies) for p in d.projects] == [("Job Portal", ["Python", "FastAPI", "React"]), ("Chat Tool", [])]
    s = d.education[0]
    assert (s.degree, s.institution, s.university, s.cgpa, s.start_year, s.end_year) == ("Bachelor of Technology (CSE)", "ABC College", "XYZ University", 8.5, 2019, 2023)
    assert d.languages == ["English", "Hindi"] and d.diagnostics.warnings == []
    assert (rows[2].status, rows[2].error, rows[3].error) == ("Failed", parsing.SHORT_TEXT, parsing.NO_TEXT)
    assert rows[4].parsed_data == d and rows[4].extracted_text == rows[1].extracted_text == parsing.clean(RESUME)


def test_sections_go_on_to_the_next_heading(spark):
    df = spark.createDataFrame([("Name\nSKILLS\nPython\nWork Experience\nDev\nskills\nTECHNICAL SKILLS:\n\n SQL\nEDUCATION",), ("",)], "t string")
    rows = df.withColumn("b", parsing.section_blocks(parsing.lines_of(F.col("t")))).select("b", parsing.all_lines(F.col("b")).alias("all"), parsing.section_lines(F.col("b"), F.lit("skills")).alias("skills")).collect()
    assert [(x.section, x.lines) for x in rows[0].b] == [("header", ["Name"]), ("skills", ["Python"]), ("experience", ["Dev", "skills"]), ("skills", ["SQL"]), ("education", [])]
    assert rows[0]["all"] == ["Name", "Python", "SQL", "Dev", "skills"] and rows[0].skills == ["Python", "SQL"]
    assert [(x.section, x.lines) for x in rows[1].b] == [("header", [])] and rows[1].skills == []


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("said,number", [("call 9876543210 now", "9876543210"), ("+91-9876543210", "+91 9876543210"), ("+91 9876543210", "+91 9876543210"), ("98765 43210", None), ("9198765432", "9198765432"), ("919876543210", "+91 9876543210"), ("12345", None), ("19876543210123", None)])
def test_phones(spark, said, number):
    assert one(spark, text.phone, said) == number


def test_whitespace_and_artifacts(spark):
    assert one(spark, text.whitespace, "a \t b ,c\r\n( d )") == "a b,c\n(d)"
    assert one(spark, text.pdf_artifacts, "CGP A : 8 – problem- solving") == "CGPA: 8 - problem-solving"


@pytest.mark.parametrize("name,least", [("ANITA RAO", 40), ("Anita Rao", 40), ("Backend Developer", None), ("anita@x.com", None), ("Python Developer with experience", None), ("Technical Skills", None), ("A B C D E F", None)])
def test_name_scores(spark, name, least):
    got = one(spark, parsing.name_score, name)
    assert got >= least if least else got < 40


def test_wrapped_lines():
    assert parsing.repair("Worked on services for\nlarge clients.\nNext item here now\n\n• bullet\n• other") == "Worked on services for large clients.\nNext item here now\n• bullet\n• other"


@pytest.mark.parametrize("said,url", [("[me](https://x.org/a)", "https://x.org/a"), ("(www.x.org).", "https://www.x.org"), ("HTTP://x.org", "HTTP://x.org"), (" . ", None), ("x.org/a,", "https://x.org/a")])
def test_urls(spark, said, url):
    assert one(spark, text.normalize_url, said) == url


@pytest.mark.parametrize("said,name", [("FAST_API", "FAST_API"), ("rest-api", "REST API"), ("REST_APIs", "REST API"), ("Node.js", "Node.js"), ("postgres", "PostgreSQL"), ("Excel", "Excel")])
def test_skill_names(spark, said, name):
    assert one(spark, parsing.normalize_skill, said) == name
    assert parsing.skill_name(said) == name


@pytest.mark.parametrize(
    "line,parts",
    [
        ("ANITA RAO Aspiring Backend Developer", ["ANITA RAO", "Aspiring Backend Developer"]),
        ("Metadata Engineer here", ["Meta", "data Engineer here"]),
        # a role word counts only with a blank behind it
        ("ANITA RAO Developer", ["ANITA RAO Developer"]),
        ("Developer ANITA", ["Developer ANITA"]),
        ("Anita Rao | anita rao • x@y.z", ["Anita Rao", "x@y.z"]),
    ],
)
def test_header_parts(spark, line, parts):
    assert one(spark, parsing.header_parts, line) == parts


def test_header_name_takes_the_best_line(spark):
    header = lambda *x: spark.createDataFrame([(list(x),)], "h array<string>").select(parsing.header_name(F.col("h"))).first()[0]
    assert header("Curriculum Vitae", "Backend Developer | Anita Rao", "ANITA RAO") == "ANITA RAO"
    assert header("Anita Rao", "Ravi Kumar") == "Anita Rao" and header("x@y.z", "12 Main Road") is None and header() is None
    assert header("a1", "b2", "c3", "d4", "e5", "f6", "ANITA RAO") is None


def parsed(spark, section, *lines):
    head = "Anita Rao of Some Town here\nemail anita@example.com or so\n"
    docs = spark.createDataFrame([(1, f"{head}{section}\n" + "\n".join(lines))], "doc_id long, text string")
    return parsing.parse_resumes(docs).first().parsed_data


def test_projects_with_inline_technologies(spark):
    rows = parsed(
        spark, "PROJECTS", "Shop Portal • Python • FastAPI • Excel", "• Took orders • Sent invoices", "Docker • rest-api • Something Else", "and a line that goes on with the last",
        "Chat Tool for All of Us", "Tech Stack: React; node.js | Postgres", "We also wrote a manual for it here", "Another line of the same project there",
    ).projects
    assert [(p.name, p.technologies) for p in rows] == [("Shop Portal", ["Python", "FastAPI", "Docker"]), ("Chat Tool for All of Us", ["React", "Node.js", "PostgreSQL"])]
    # "rest-api" is no known search name, so the line tells of it
    assert rows[0].description == ["Took orders", "Sent invoices", "rest-api", "Something Else and a line that goes on with the last"]
    assert rows[1].description == ["We also wrote a manual for it here Another line of the same project there"]


def test_projects_need_a_title(spark):
    assert parsed(spark, "PROJECTS", "• A bullet before any title here", "Technologies: Python", "Just prose that stands alone in here").projects == []
    only = parsed(spark, "PROJECTS", "Shop Portal • Python").projects
    assert [(p.name, p.technologies, p.description) for p in only] == [("Shop Portal", ["Python"], [])]


def test_experience_entries(spark):
    rows = parsed(spark, "EXPERIENCE", "prose before any heading is not kept at all", "Intern | Acme (2020) | Remote", "• Built things • Tested them", "with care and some more words here", "Senior Analyst of Data, 2019 - Present", "2018 | 2017").experience
    assert [(e.title, e.company, e.organization, e.start_year, e.end_year) for e in rows[:2]] == [("Intern", "Acme", "Remote", None, 2020), ("Senior Analyst of Data", None, None, 2019, None)]
    assert rows[0].description == ["Built things", "Tested them with care and some more words here"]
    assert (rows[2].title, rows[2].end_year) == ("2017", 2018)


def test_education_entries(spark):
    rows = parsed(spark, "EDUCATION", "Sunrise College and its many halls", "Bachelor of Science (Physics), State University", "CGPA: 8.25 / 10, 2012 - 2015", "M.Tech from the Institute of Things, 2016 – 2018 GPA 3.9").education
    assert [(e.degree, e.institution, e.university, e.cgpa, e.start_year, e.end_year) for e in rows] == [
        (None, "Sunrise College and its many halls", None, None, None, None),
        ("Bachelor of Science (Physics)", None, "State University", 8.25, 2012, 2015),
        ("M.Tech", "M.Tech from the Institute of Things", None, 3.9, 2016, 2018),
    ]


def test_fragments(spark):
    df = spark.createDataFrame([(["Builds services with hands-", "on care", "And then some more of it", "• bullet", "lower case goes on here too"],)], "x array<string>")
    assert df.select(parsing.repair_fragments(F.col("x"))).first()[0] == ["Builds services with hands- on care", "And then some more of it", "• bullet lower case goes on here too"]


def test_clean_up_is_done_twice():
    once = parsing.clean("We like problem-\nsolving and object-\noriented work  , much\n.")
    assert once == "We like problem- solving and object- oriented work, much." and parsing.clean(once) == "We like problem-solving and object-oriented work, much."
    assert parsing.clean("a\r\n\r\n b ( c )") == "a\nb (c)" and parsing.clean("a\nb (c)") == "a b (c)"


def test_parsing_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, RESUME, "x"), (1, "  ", "y"), (1, RESUME, "y")], "doc_id long, text string, name string")
    rows = parsing.parse_resumes(docs).collect()
    assert len(rows) == 3 and sum(r.status == "Completed" for r in rows) == 2
    assert parsing.parse_resumes(docs.limit(0)).count() == 0
    plan = parsing.parse_resumes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


# ---- sources and streams


def test_stored_names(spark):
    name = spark.createDataFrame([("My CV.PDF",)], "n string").select(marketplace.stored_name(F.col("n"))).first()[0]
    assert len(name) == 36 and name.endswith(".pdf") and set(name[:32]) <= set("0123456789abcdef")


def test_pages_after_the_last_row_seen(spark):
    jobs = marketplace.StarSchema(spark, SF).jobs
    for order in ("asc", "desc"):
        last, seen = None, []
        while rows := relational.page_after(jobs, "salary", order, 70, last).collect():
            seen += [r.id for r in rows]
            last = (rows[-1].salary, rows[-1].id)
        assert seen == [r.id for r in relational.sort(jobs, "salary", order, ("salary",)).collect()]


def test_status_log_over_several_chunks():
    at = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame([(1, 1, "Applied", at), (1, 2, "Shortlisted", at + pd.Timedelta(1, "h")), (1, 3, "Selected", at + pd.Timedelta(2, "h"))], columns=["application_id", "id", "new_status", "changed_at"])

    class State:
        exists = False

        def update(self, value):
            self.value = value

    state = State()
    got = pd.concat(status_log._judge((1,), iter([rows[2:], rows[:1], rows[1:2]]), state))
    assert got["accepted"].all() and state.value == ("Selected",)


def docx(paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_resume_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["Name", " ", "Skills"]))
    (tmp_path / "b.docx").write_bytes(b"PK nonsense")
    (tmp_path / "c.txt").write_bytes(b"text")
    (tmp_path / "d.pdf").write_bytes(b"not a pdf")
    rows = {r.path[-6:]: r for r in marketplace.read_resume_files(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].extracted_text == "Name\nSkills" and rows["a.docx"].error is None
    assert {k: r.error for k, r in rows.items() if r.error} == {"b.docx": "not a DOCX", "/c.txt": "unsupported type", "/d.pdf": "not a PDF"}


def make_pdf(*pages, flate=False, packed=False, cmap=None):
    """A PDF of content streams; ``packed`` puts the dictionaries into an object stream."""
    plain, streams = {}, {}
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    plain[1], plain[2] = "<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F1 5 0 R >> >> >>"
    plain[5] = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica" + (" /ToUnicode 6 0 R" if cmap else "") + " >>"
    if cmap:
        streams[6] = cmap.encode()
    for k, content in enumerate(pages):
        plain[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>"
        streams[11 + 2 * k] = content.encode("latin-1")
    out = b"%PDF-1.5\n"
    if packed:
        bodies = [v.encode() for v in plain.values()]
        offsets = [sum(len(b) + 1 for b in bodies[:k]) for k in range(len(bodies))]
        table = " ".join(f"{n} {o}" for n, o in zip(plain, offsets, strict=True)).encode() + b" "
        body = zlib.compress(table + b" ".join(bodies))
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (len(plain), len(table), body)
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % (n, v.encode()) for n, v in plain.items())
    for n, v in streams.items():
        v = zlib.compress(v) if flate else v
        out += b"%d 0 obj << /Length %d%s >> stream\r\n%s\nendstream\nendobj\n" % (n, len(v), b" /Filter /FlateDecode" if flate else b"", v)
    return out + b"%%EOF"


PAGE = r"BT /F1 12 Tf 72 700 Td (ANITA \(RAO\)) Tj 0 -14 Td [(Py) -20 (thon) -300 (Caf\351)] TJ T* (SKILLS) Tj ET BT 1 0 0 1 72 600 Tm (Git) Tj 1 0 0 1 99 600 Tm (Hub) Tj ET"


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("flate", [False, True])
def test_pdf_text(flate, packed):
    assert Pdf(make_pdf(PAGE, "BT (second) ' ET", flate=flate, packed=packed)).text() == "ANITA (RAO)\nPython Caf\xe9\nSKILLS\nGitHub\nsecond"


def test_pdf_text_by_unicode_map():
    cmap = "1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0004> <0062> <0005> <0006> [<00660069> <0939>] endbfrange"
    assert Pdf(make_pdf("BT /F1 9 Tf <000100020003> Tj <0005 0006 0009> Tj ET", cmap=cmap)).text() == "Abcfi\u0939"
    assert Pdf(b"%PDF-1.4 nothing").text() == "" and Pdf(make_pdf("")).text() == ""


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf(PAGE, flate=True))
    row = marketplace.read_resume_files(spark, str(tmp_path)).first()
    assert row.error is None and row.extracted_text.startswith("ANITA (RAO)\n")


def test_tables_round_trip(spark, tmp_path):
    users = spark.createDataFrame([(1, "ann", "a@x", "secret", datetime.date(2000, 1, 1), "Admin")], schemas.SCHEMAS["users"])
    users.write.parquet(f"{tmp_path}/users")
    back = marketplace.read_table(spark, str(tmp_path), "users")
    assert back.first() == users.first() and "password" not in schemas.public(back).columns
    assert marketplace.health(spark).first().ok == 1 and marketplace.find(back, 1).count() == 1
    assert '"username":"ann"' in marketplace.to_json_rows(schemas.public(back)).first().json


def test_status_stream(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    schema = "application_id long, id long, new_status string, changed_at timestamp"
    spark.createDataFrame([(1, 1, "Applied", at(1)), (1, 2, "Selected", at(2)), (1, 3, "Shortlisted", at(3)), (2, 4, "Applied", at(1))], schema).coalesce(1).write.json(f"{tmp_path}/in")
    log = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    query = status_log.validated(log).writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.id: r.accepted for r in spark.table("judged").collect()} == {1: True, 2: False, 3: True, 4: True}
    query = status_log.counts_by_window(log).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.new_status: r["count"] for r in spark.table("counted").collect()} == {"Applied": 2, "Selected": 1, "Shortlisted": 1}
