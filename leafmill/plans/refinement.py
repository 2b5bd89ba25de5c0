"""From a first score to a judged prompt: ask for instructions, try them, keep what helps.

Two calls to a model follow one another: one writes instructions for a page whose fields are
mostly empty, the next extracts with them. Answers are paid for, so both are stored under the page
and a digest of the request; a run that is repeated after a failure asks only for what is missing.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.operators import requests, responses
from leafmill.plans import extraction
from leafmill.session import new_dir, stage


class RefinedRun(NamedTuple):
    """``written``: per asked page the text that came back, and what became of it. ``candidates``:
    the usable texts with their cost. ``retried``: the second requests. ``refined``: scores, the
    choice, the kept records and the judged prompt rows."""

    written: DataFrame
    candidates: DataFrame
    retried: DataFrame
    refined: extraction.Refined


def ask_once(reqs: DataFrame, extractor: requests.Extractor, path: str) -> DataFrame:
    """Answers to all of ``reqs``, asking only for those that ``path`` does not hold yet.

    An answer belongs to its page and its request (a digest of prompt and content), so that a
    changed request is asked anew and an old answer to it is not mistaken for one. New answers
    are added when all of them are there; a job that fails before adds none. Requests whose page
    got no answer are asked again the next time.
    """
    spark = reqs.sparkSession
    said = F.coalesce("system_prompt", F.lit("")), F.lit("\0"), F.coalesce("user_content", F.lit(""))
    keyed = stage(reqs.withColumn("request_key", F.sha2(F.concat(*said), 256)), "requests")
    of = ["page_id", "request_key"]
    schema = f"{requests.RESPONSE_SCHEMA}, request_key string"
    try:
        known = spark.read.schema(schema).parquet(path)
        open_ = keyed.join(known.select(*of), of, "left_anti")
    except AnalysisException:  # nothing was asked yet
        open_ = keyed
    new = requests.run_extractor(open_.drop("request_key"), extractor)
    new.join(keyed.select(*of), "page_id").select(*[c.split()[0] for c in schema.split(", ")]).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(keyed.select(*of), of, "left_semi").drop("request_key")


def refine_run(
    run: extraction.Run,
    schema: dict[str, Any],
    writer: requests.Extractor,
    extractor: requests.Extractor,
    ts: F.Column,
    *,
    instructions: str = "",
    prompts: DataFrame | None = None,
    minimum_improvement: float = fv.MINIMUM_IMPROVEMENT,
    path: str | None = None,
) -> RefinedRun:
    """Measured refinement of the pages in ``run.retry`` (a score below the limit, tried once).

    Pages with a fill rate below one half, and with text, are put to ``writer``. Its reply is
    trimmed; one of more than 20 characters is the page's candidate; a shorter one is rejected and
    the text for the page's first issue is used, as for pages that were not put to it. Where the
    writer fails or says nothing, the page is not tried again. ``extractor`` answers the second
    requests; a page keeps its second records if its score rose by ``minimum_improvement``, and its
    candidate becomes a prompt row, accepted or rejected by the same measure, with the cost of
    both calls. ``path`` names the folder of the answers (see ``ask_once``); without one, nothing
    is found again. Page ids are unique. Without pages to retry, all tables are empty or as before.
    """
    folder = path or new_dir(run.quality.sparkSession, "refinement")
    asked = requests.refinement_requests(run.retry, run.records, run.cleaned, schema)
    answers = ask_once(asked, writer, f"{folder}/written")
    texts = responses.text_answers(answers).join(answers.select("page_id", F.col("error_type").alias("_given"), "latency_ms", "input_tokens", "output_tokens"), "page_id")
    told = asked.select("page_id").join(texts, "page_id", "left").select(
        "page_id", "answer", F.when(F.col("answer").isNull(), F.coalesce("_given", F.lit("LLMExtractionError"))).alias("error_type"),
        "latency_ms", "input_tokens", "output_tokens",
    )
    written = stage(told, "written")
    candidates = stage(
        responses.refinement_candidates(written).select(
            "page_id", F.col("answer").alias("extra_instructions"), "latency_ms", "input_tokens", "output_tokens"
        ),
        "candidates",
    )
    silent = written.where(F.col("error_type").isNotNull()).select("page_id")
    tried = run._replace(retry=run.retry.join(silent, "page_id", "left_anti"))
    retried = extraction.retry_requests(tried, schema, instructions=instructions, candidates=candidates)
    second = ask_once(retried, extractor, f"{folder}/second")
    refined = extraction.finish_retry(
        run, second, schema, ts, candidates=candidates, prompts=prompts, minimum_improvement=minimum_improvement
    )
    return RefinedRun(written, candidates, retried, refined)
