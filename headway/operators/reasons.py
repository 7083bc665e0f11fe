"""Why a line is disrupted, by a language model that is passed in: the question, its checked answer, the scores.

A model that fails or declines gives an answer without a group and its error; scores count it as wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.errors import RefusedError
from headway.functions.text import GROUPS
from headway.operators import retrieval

#: What the model is asked to do; how it says so is the model's business.
INSTRUCTIONS = (
    "Name the cause group of a rail disruption from the situation told and the past incidents shown, if any. "
    f"The groups are {', '.join(GROUPS)}. Cite a past incident by its alert ids as they are written, and only if it bears on the case; "
    "explain in one or two sentences."
)
NO_GROUP = "none"
ANSWER = "cause_group string, explanation string, cited_alert_ids array<string>, error string"


def question(situation: Column, passages: Column) -> Column:
    """The situation in words and the passages (array of alert_ids, cause_group, text) shown with it.

    NULL passages: none are offered; an empty array: none were found.
    """
    # The headings' wording.
    ids = lambda p: F.array_join(F.transform(p["alert_ids"], lambda x: F.substring(x, 1, 8)), ", ")
    each = F.transform(passages, lambda p: F.concat(F.lit("[alerts "), ids(p), F.lit("] cause group: "), p["cause_group"], F.lit("\n"), p["text"]))
    shown = (
        F.when(passages.isNull(), F.array(F.lit("No past incidents are provided.")))
        .when(F.size(passages) == 0, F.array(F.lit("Past incidents were searched for, and none was found.")))
        .otherwise(F.concat(F.array(F.lit("Past incidents, most similar first:")), each))
    )
    return F.array_join(F.concat(F.array(F.concat(F.lit("Situation: "), situation)), shown), "\n\n")


def checked(answer: dict) -> dict:
    """The answer, if it has the right form; else an error that says what is wrong."""
    group, said, cited = answer.get("cause_group"), answer.get("explanation"), answer.get("cited_alert_ids", [])
    if group not in GROUPS:
        raise ValueError(f"cause_group is {group!r}; it must be one of {', '.join(GROUPS)}")
    if not isinstance(said, str) or not isinstance(cited, (list, tuple)) or not all(isinstance(x, str) for x in cited):
        raise ValueError("explanation must be a text and cited_alert_ids a list of texts")
    return {"cause_group": group, "explanation": said, "cited_alert_ids": list(cited), "error": None}


def explain(cases: DataFrame, model: Callable[[str, str], dict], question_col: str = "question") -> DataFrame:
    """``cases`` with the model's checked answer to each question; ``model`` takes (instructions, question)."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q in pdf[question_col]:
                try:
                    out.append(checked(model(INSTRUCTIONS, q)))
                except Exception as e:  # noqa: BLE001  a refusal or a failure is recorded, not hidden
                    kind = "declined" if isinstance(e, RefusedError) else type(e).__name__
                    out.append({"cause_group": None, "explanation": None, "cited_alert_ids": None, "error": f"{kind}: {e}"})
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["cause_group", "explanation", "cited_alert_ids", "error"], dtype=object)], axis=1)

    return cases.mapInPandas(run, f"{names}, {ANSWER}")


def with_citations_checked(answers: DataFrame, passages_col: str = "passages") -> DataFrame:
    """``answers`` with unsupported_citations: ids that were cited but not shown."""
    shown = F.flatten(F.transform(F.coalesce(F.col(passages_col)["alert_ids"], F.array().cast("array<array<string>>")), lambda ids: F.transform(ids, lambda x: F.substring(x, 1, 8))))
    return answers.withColumn("unsupported_citations", F.array_except(F.coalesce("cited_alert_ids", F.array().cast("array<string>")), shown))


def past_incidents(cases: DataFrame, index: DataFrame, k: int = 3, vector: str = "vector") -> DataFrame:
    """For each case (id, first_seen_ts, vector) the k incidents of the index most like it that were seen before it.

    Both guards act before the best are kept: the case itself and whatever was first seen in or after its
    second are never among them.
    """
    # The cases' times, which are few, go into the guard's expression.
    at = {int(r["id"]): int(r["first_seen_ts"]) for r in cases.select("id", "first_seen_ts").toLocalIterator()}
    times = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])
    return retrieval.top_k_for(cases, index, k, vector, "id", guard=lambda q, i: (F.col("first_seen_ts") < F.try_element_at(times, q)) & (i != q), beside=["first_seen_ts"])


def macro_f1_sums(rows: DataFrame, truth: str, guess: str, date: str, groups: Sequence[str] = GROUPS) -> DataFrame:
    """A row a date with the counts that a macro-F1 is made of: n_, g_ and t_ (of truth, guessed, both) of each group."""
    g, t = F.coalesce(F.col(guess), F.lit(NO_GROUP)), F.col(truth)
    sums = [x for name in groups for x in (F.count_if(t == name).alias(f"n_{name}"), F.count_if(g == name).alias(f"g_{name}"), F.count_if((t == name) & (g == name)).alias(f"t_{name}"))]
    return rows.groupBy(F.col(date).alias("date")).agg(*sums)


def macro_f1_of(groups: Sequence[str] = GROUPS) -> tuple[list[str], Callable[..., Column]]:
    """Names of the sums, and the macro-F1 of them over the groups that occur: a metric for the date bootstrap."""
    names = [f"{k}_{g}" for g in groups for k in ("n", "g", "t")]

    def metric(*sums: Column) -> Column:
        of = dict(zip(names, sums, strict=True))
        each = F.array(*[F.when(of[f"n_{g}"] > 0, F.try_divide(2 * of[f"t_{g}"], of[f"n_{g}"] + of[f"g_{g}"])) for g in groups])
        present = F.filter(each, lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))

    return names, metric
