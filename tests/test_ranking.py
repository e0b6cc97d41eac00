"""The best jobs of every résumé against the scores of all pairs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talentloom.operators import ranking, scoring

JOBS = "id long, title string, description string, skills array<string>"
RESUMES = "resume_id long, extracted_text string, parsed_data string"
SKILLS = ["python", "sql", "docker", "aws", "react", "java", "team spirit", "haskell", "unit testing"]
SAID = ["backend developer", "relational databases", "cloud deployments", "agile development", "minimum 3 years of experience required", "bachelor's degree in computer science required", "master's degree required", "5 years of experience required", "debugging"]


def tables(spark, rng, n_resumes, n_jobs):
    jobs = [(i, "", ". ".join(rng.sample(SAID, rng.choice([0, 0, 1, 2, 4]))), rng.sample(SKILLS, rng.choice([0, 1, 1, 2, 5]))) for i in rng.sample(range(1000), n_jobs)]
    data = lambda: {"skills": rng.sample(SKILLS, rng.choice([0, 1, 3])), "education": rng.choice(["", "B.Tech computer science", "MCA"]), "experience": [f"{rng.randrange(6)} years"], "projects": rng.sample(SAID[:4], rng.choice([0, 1]))}
    resumes = [(i, rng.choice(["", None, "python sql"]) or ("python docker debugging" if i % 3 else ""), json.dumps(data())) for i in range(n_resumes)]
    return spark.createDataFrame(resumes, RESUMES), spark.createDataFrame(jobs, JOBS)


def all_pairs(resumes, jobs, best):
    pairs = resumes.select("resume_id").crossJoin(jobs.select(F.col("id").alias("job_id")))
    rows = scoring.score_pairs(pairs, resumes, jobs).select("resume_id", "job_id", "overall_score").collect()
    out = {}
    for r in sorted(rows, key=lambda r: (-r.overall_score, r.job_id)):
        out.setdefault(r.resume_id, []).append((r.job_id, r.overall_score))
    return sorted((i, k + 1, j, s) for i, v in out.items() for k, (j, s) in enumerate(v[:best]))


@pytest.mark.parametrize("best,chunk", [(4, 100_000), (10, 3)])
def test_ranking_is_that_of_all_pairs(spark, best, chunk):
    """With parts of three kinds of résumés most terms are split."""
    resumes, jobs = tables(spark, random.Random(best), 45, 60)
    got = sorted(map(tuple, ranking.best_jobs(resumes, jobs, best, chunk).collect()))
    assert got == all_pairs(resumes, jobs, best)


def test_most_pairs_are_never_formed(spark, monkeypatch):
    formed, scored = [], ranking._scored
    monkeypatch.setattr(ranking, "_scored", lambda pairs, *a: formed.append(pairs.count()) or scored(pairs, *a))
    resumes, jobs = tables(spark, random.Random(1), 120, 400)
    df = ranking.best_jobs(resumes, jobs, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 360 and sum(formed) < 120 * 400 / 3
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty_sides_and_fewer_jobs(spark):
    resumes, jobs = tables(spark, random.Random(2), 5, 3)
    assert ranking.best_jobs(resumes, jobs).groupBy("resume_id").count().filter("count = 3").count() == 5
    assert ranking.best_jobs(resumes, jobs.limit(0)).count() == 0
    assert ranking.best_jobs(resumes.limit(0), jobs).count() == 0
