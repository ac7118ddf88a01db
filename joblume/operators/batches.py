"""Detail pages to batch texts, and batch texts to extraction requests."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblume.functions.markup import page_extract
from joblume.functions.text import CONFIGURED_CHAR_LIMIT, card_text, line_compact, strip, truncate
from joblume.operators.skew import spread_join

# What the model is told, and how it is called -----------------
ADVERT_MARK = "=== NOVA VAGA ==="
BATCH_SEPARATOR = "\n\n=== NOVA VAGA ===\n\n"
SYSTEM_PROMPT = (
    "Você é um extrator de dados estruturados especialista. Extraia as informações detalhadas "
    "do texto, prestando MUITA ATENÇÃO a Salário e Requisitos."
)
JOBS_PROMPT_SUFFIX = (
    " O texto pode conter múltiplas vagas separadas por '=== NOVA VAGA ==='. "
    "Extraia os detalhes de CADA UMA."
)
MODEL = "gemini-2.5-flash"
TEMPERATURE = 0.1
MAX_TOKENS = 4096
# ----------------------------------------------------------------------------


def with_page(pages: DataFrame, format: str = "markdown") -> DataFrame:
    """Adds the extracted struct as ``page``.  The one Python stage."""
    return pages.withColumn("page", page_extract(F.col("html"), format))


def clean_text(page: Column, char_limit: int = CONFIGURED_CHAR_LIMIT) -> Column:
    """Compact text of an extracted page; NULL if it could not be read."""
    text = F.when(F.size(page["card_texts"]) > 1, card_text(page["card_texts"])).otherwise(page["body"])
    return truncate(line_compact(text), char_limit)


def is_ready_text(text: Column) -> Column:
    """Text that goes to the model as it is: a batch, or something that is no markup."""
    return text.contains(ADVERT_MARK) | ~strip(text).startswith("<")


def route_text(raw: Column, cleaned: Column) -> Column:
    return F.when(is_ready_text(raw), raw).otherwise(cleaned)


def join_details(links: DataFrame, details: DataFrame, keep_missing: bool = False,
                 row_id: list[str] | None = None) -> DataFrame:
    """Links with the texts of the pages they point to.

    ``details`` holds ``href`` (unique) and what to add.  Everyone may link to
    the same page, so the join spreads hot links over slots.
    """
    return spread_join(links, details, "href", "left" if keep_missing else "inner",
                       row_id or [c for c in links.columns if c != "href"])


def missing_details(links: DataFrame, details: DataFrame) -> DataFrame:
    """Links without a page: told, not fatal."""
    return spread_join(links, details.select("href"), "href", "left_anti",
                       [c for c in links.columns if c != "href"])


def batch_texts(linked: DataFrame, keys: list[str], text: str = "clean_text") -> DataFrame:
    """One text per batch, in link order; ``linked`` keeps links without a text.

    A batch whose pages are all missing is an empty text, and still a batch.  A
    group is one batch, so its size is bounded by the batch size.  With a
    ``parse_error`` among the columns, ``n_unread`` counts pages that were there
    and could not be read.
    """
    unread = [F.count("parse_error").alias("n_unread")] if "parse_error" in linked.columns else []
    entry = F.when(F.col(text).isNotNull(),
                   F.struct("pos", F.concat(F.lit("URL: "), "href", F.lit("\n"), text).alias("entry")))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"])
    return (linked.groupBy(*keys, "batch_no")
            .agg(F.array_join(entries, BATCH_SEPARATOR).alias("batch_text"),
                 F.count(F.lit(1)).alias("n_links"), F.count(text).alias("n_texts"), *unread))


def system_prompt(niche: str) -> str:
    return SYSTEM_PROMPT + (JOBS_PROMPT_SUFFIX if niche == "jobs" else "")


def build_requests(texts: DataFrame, text: str, niche: str = "jobs", model: str = MODEL,
                   temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds the request columns an extraction service takes."""
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    return texts.withColumns({
        "model": F.lit(model),
        "messages": F.array(message("system", F.lit(system_prompt(niche))), message("user", F.col(text))),
        "temperature": F.lit(temperature),
        "max_output_tokens": F.lit(max_tokens),
    })


# How often a call is tried, and the shortest and longest wait in seconds.
ATTEMPTS = 5
WAIT = (10.0, 60.0)


def call_extractor(requests: DataFrame, extractor: Callable[[str, str], str], keys: list[str], text: str,
                   attempts: int = ATTEMPTS, wait: tuple[float, float] = WAIT,
                   final: tuple[type[Exception], ...] = (ValueError, TypeError)) -> DataFrame:
    """The seam to a model: ``extractor(system, text) -> JSON``, called in the tasks.

    A failing call is tried ``attempts`` times in all, with waits that double
    between the two bounds; errors of the ``final`` kinds are not tried again.
    What fails to the end loses its own batch only: the reply is NULL and the
    reason is in ``call_error``.  Land the result before using it twice, or
    calls repeat; ``unanswered`` picks what may be sent again.
    """
    fields = {field.name: field for field in requests.schema.fields}
    schema = ", ".join(f"`{key}` {fields[key].dataType.simpleString()}" for key in keys)

    def call(frames):
        for frame in frames:
            replies, errors = [], []
            for system, content in zip(frame.pop("_system"), frame.pop("_content")):
                for attempt in range(max(1, attempts)):
                    try:
                        answer = extractor(system, content), None
                        break
                    except Exception as failure:
                        answer = None, f"{type(failure).__name__}: {failure}"
                        if isinstance(failure, final) or attempt + 1 >= attempts:
                            break
                        time.sleep(min(wait[0] * 2**attempt, wait[1]))
                replies.append(answer[0])
                errors.append(answer[1])
            yield frame.assign(response=replies, call_error=errors)

    return (requests.select(*keys, F.col("messages")[0]["content"].alias("_system"), F.col(text).alias("_content"))
            .mapInPandas(call, f"{schema}, response string, call_error string"))


def unanswered(requests: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose landed call failed, to be sent again; what was answered is not paid for twice."""
    failed = answered.where(F.col("call_error").isNotNull()).select(*keys)
    return requests.join(failed, keys, "left_semi")
