"""The best jobs for every résumé, without forming all pairs.

Résumés that are alike in all features have the same ranking, so each kind is ranked once. Of jobs that are alike only the
``best`` smallest ids can be in a ranking.

A score is the sum of what matching skills (up to 40) and keywords (up to 25) give, what jobs that ask for none give anyway, and at
most 35 for experience and education. That gives an upper bound for a pair, and an inverted index from terms to jobs finds the
pairs that can reach it:

1. Jobs that a résumé has no term of score by their class (what they demand of education and years, and which of skills and keywords
   they don't ask for). The best of these are worked out for each class of résumés, by level, fields and years.
2. Each term's champions, the ``best`` jobs that it gives most for, and those of 1 are scored; a résumé's ``best``-th score is a
   threshold that its ranking can't fall below.
3. A job's terms are ordered from rare to frequent. If a pair's rarest common term is t, all it can gain is what the job gives for t and
   the terms behind it (the prefix filter): pairs meet on a term only if that and the bound of the rest reach the threshold. A frequent
   term stands last, so it joins only the jobs that ask for little else.

A term that more than ``chunk`` kinds of résumés have is split: they are dealt to as many parts, and its jobs go to each part.
Equal scores rank by job id. A résumé without terms is ranked by 1 alone. Empty tables give no ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentloom.operators import scoring
from talentloom.sources.tables import written

OF_RESUME = ("resume_skills", "resume_keywords", "projects_show", "resume_level", "resume_fields", "resume_years")
OF_JOB = ("job_skills", "job_keywords", "project_keywords", "required_years", "required_level", "job_fields", "names_degree")
#: What experience and education can give, and what rounding may add to a sum of shares.
REST, SLACK = 35.0, 0.05


def _kind(columns: tuple[str, ...], sets: tuple[str, ...]) -> list:
    """Columns that say whether rows are alike; the order of lists doesn't matter."""
    return [F.array_sort(c).alias(c) if c in sets else F.col(c) for c in columns]


def _first(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups before it shuffles them."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def _tagged(**lists: str):
    """One array of terms, each with its list's letter."""
    marked = lambda k, c: F.transform(c, lambda t: F.concat(F.lit(f"{k}:"), t))
    return F.array_distinct(F.concat(*(marked(k, c) for k, c in lists.items())))


def job_terms(jobs: DataFrame) -> DataFrame:
    """job, term, gain (what the term gives) and given (what the job gives without any) of jobs with their features."""
    share = lambda c, w: F.when(F.size(c) > 0, F.lit(float(w)) / F.size(c)).otherwise(0.0)
    skill, keyword = share("job_skills", scoring.WEIGHTS["skill_score"]), share("job_keywords", scoring.WEIGHTS["keyword_score"])
    rows = jobs.select("job", given().alias("given"), skill.alias("s"), keyword.alias("k"), F.explode(_tagged(s="job_skills", k="job_keywords", p="project_keywords")).alias("term"))
    gain = F.when(F.col("term").startswith("s:"), F.col("s")).when(F.col("term").startswith("k:"), F.col("k")).otherwise(0.0)
    return rows.select("job", "term", gain.alias("gain"), "given")


def given():
    """What a job gives to any résumé: full marks for what it doesn't ask for."""
    whole = lambda c, name: F.when(F.size(c) == 0, float(scoring.WEIGHTS[name])).otherwise(0.0)
    return whole("job_skills", "skill_score") + whole("job_keywords", "keyword_score")


def postings(terms: DataFrame, frequency: DataFrame) -> DataFrame:
    """job, term, most: what a pair can score whose rarest common term this is."""
    rows = terms.join(frequency, "term")
    behind = W.partitionBy("job").orderBy(F.col("kinds").desc(), F.col("term")).rowsBetween(W.unboundedPreceding, 0)
    return rows.select("job", "term", "parts", (F.sum("gain").over(behind) + F.col("given") + REST + SLACK).alias("most"))


def _without_terms(resumes: DataFrame, jobs: DataFrame, best: int) -> DataFrame:
    """resume, job: for each résumé the best jobs of those that it may have no term of.

    Classes are few: levels, fields and the numbers of years that texts name. Those of jobs go to each class of résumés as one array.
    """
    demands = ["required_years", "required_level", "job_fields", "names_degree"]
    classes = _first(jobs.select("job", given().alias("given"), *demands), ["given", *demands], ["job"], best)
    classes = classes.groupBy("given", *demands).agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    every = classes.agg(F.collect_list(F.struct("given", *demands, "jobs")).alias("c")).scalar()
    mine = ["resume_level", "resume_fields", "resume_years"]
    rows = resumes.select(*mine).distinct().withColumn("c", every).select(*mine, F.explode("c").alias("c")).select(*mine, "c.*")
    no = F.lit(0).cast("decimal(5,2)")
    whole = F.lit(100).cast("decimal(5,2)")
    rows = rows.withColumns({"skill_score": F.when(F.col("given").isin(40.0, 65.0), whole).otherwise(no), "keyword_score": F.when(F.col("given").isin(25.0, 65.0), whole).otherwise(no), "education_score": scoring.education_score(), "experience_score": scoring.experience_score(no)})
    rows = rows.withColumn("score", scoring.overall_score(rows)).select(*mine, "score", F.explode("jobs").alias("job"))
    top = _first(rows, mine, [F.col("score").desc(), "job"], best).select(*(F.col(c).alias(f"c_{c}") for c in mine), "job")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in mine]
    return resumes.join(top, same).select("resume", "job")


def _scored(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    return scoring.score_features(pairs.join(resumes, "resume").join(jobs, "job")).select("resume", "job", "overall_score")


def best_jobs(resumes: DataFrame, jobs: DataFrame, best: int = 10, chunk: int = 100_000) -> DataFrame:
    """resume_id, rank, job_id, overall_score: the ``best`` jobs of each résumé by their score. Inputs as for ``score_pairs``."""
    of_resumes, of_jobs = scoring.features(resumes, jobs)
    sets = {"resume_skills", "resume_keywords", "projects_show", "resume_fields", "job_skills", "job_keywords", "project_keywords", "job_fields"}
    of_resumes = written(of_resumes.select("resume_id", *_kind(OF_RESUME, tuple(sets))).withColumn("resume", F.sha2(F.to_json(F.struct(*OF_RESUME)), 256)), "resumes")
    kinds = written(of_resumes.select("resume", *OF_RESUME).dropDuplicates(["resume"]), "kinds")
    of_jobs = of_jobs.select(F.col("job_id").alias("job"), *_kind(OF_JOB, tuple(sets)))
    of_jobs = written(_first(of_jobs, list(OF_JOB), ["job"], best), "jobs")

    have = kinds.select("resume", F.explode(_tagged(s="resume_skills", k="resume_keywords", p="projects_show")).alias("term"))
    frequency = have.groupBy("term").agg(F.count("*").alias("kinds")).withColumn("parts", F.ceil(F.col("kinds") / chunk).cast("int"))
    frequency = written(frequency, "frequency")
    index = written(postings(job_terms(of_jobs), frequency), "index")
    part = lambda parts: F.pmod(F.xxhash64("resume"), parts).cast("int")
    have = have.join(frequency.select("term", "parts"), "term").select("resume", "term", part(F.col("parts")).alias("part"))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    champions = _first(index, ["term", "part"], [F.col("most").desc(), "job"], best).select("term", "part", "job")
    some = have.join(champions, ["term", "part"]).select("resume", "job").unionByName(_without_terms(kinds, of_jobs, best)).distinct()
    some = written(_scored(some, kinds, of_jobs), "some")
    least = _first(some, ["resume"], [F.col("overall_score").desc(), "job"], best).groupBy("resume").agg(F.min("overall_score").alias("least"), F.count("*").alias("n"))
    least = least.select("resume", F.when(F.col("n") >= best, F.col("least").cast("double")).otherwise(0.0).alias("least"))
    more = have.join(least, "resume").join(index.select("term", "part", "job", "most"), ["term", "part"]).filter("most >= least")
    more = more.select("resume", "job").distinct().join(some.select("resume", "job"), ["resume", "job"], "left_anti")
    every = some.unionByName(_scored(more, kinds, of_jobs))
    place = F.row_number().over(W.partitionBy("resume").orderBy(F.col("overall_score").desc(), "job"))
    ranked = every.withColumn("rank", place).filter(F.col("rank") <= best)
    return of_resumes.select("resume_id", "resume").join(ranked, "resume").select("resume_id", "rank", F.col("job").alias("job_id"), "overall_score")
