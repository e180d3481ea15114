"""Multi-turn sessions: evidence gathered so far and context of earlier turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import ordered_chunks, running_total


def first_citations(turns: DataFrame) -> DataFrame:
    """``session_id, evidence_id, first_turn``: every id at its first occurrence.

    ``turns`` has ``session_id, turn, evidence_ids``.  The evidence of a
    session as of turn t are the rows with ``first_turn <= t``.
    """
    cited = turns.select("session_id", "turn", F.explode("evidence_ids").alias("evidence_id"))
    return cited.groupBy("session_id", "evidence_id").agg(F.min("turn").alias("first_turn"))


def session_evidence(turns: DataFrame) -> DataFrame:
    """New and cumulative number of distinct evidence ids per turn."""
    new = first_citations(turns).groupBy("session_id", F.col("first_turn").alias("turn")).agg(
        F.count(F.lit(1)).alias("new_ids")
    )
    per_turn = (
        turns.select("session_id", "turn")
        .distinct()
        .join(new, ["session_id", "turn"], "left")
        .select("session_id", "turn", F.coalesce("new_ids", F.lit(0)).alias("new_ids"))
    )
    chunks = ordered_chunks(per_turn, ["session_id"], ["turn"])
    total = running_total(chunks, ["session_id"], ["turn"], "new_ids", "earlier")
    return total.select("session_id", "turn", "new_ids", (F.col("earlier") + F.col("new_ids")).alias("total_ids"))


def context_lines(turns: DataFrame) -> DataFrame:
    """One numbered context line per turn.

    The context of a later turn is the lines of all earlier turns in order;
    kept as rows, a long session does not repeat its text for every turn.
    ``turns`` has ``session_id, turn, question, finding``.
    """
    finding = F.coalesce("finding", F.lit(""))
    lines = turns.select(
        "session_id", "turn", F.concat(F.lit("asked "), F.col("question"), F.lit(" | found "), finding).alias("line")
    ).withColumn("_one", F.lit(1))
    chunks = ordered_chunks(lines, ["session_id"], ["turn"])
    numbered = running_total(chunks, ["session_id"], ["turn"], "_one", "earlier")
    return numbered.select("session_id", "turn", (F.col("earlier") + 1).alias("line_no"), "line")


def turn_prompts(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """``session_id, turn, prompt``: each asked question after the lines of all earlier turns of its session.

    ``asked`` has ``session_id, turn, question``.  A prompt holds its whole
    context, so ask for the turns that are wanted, not for all of a session.
    """
    wanted = asked.select("session_id", F.col("turn").alias("asked_turn"), "question")
    earlier = wanted.join(lines, "session_id", "left").where(F.col("turn").isNull() | (F.col("turn") < F.col("asked_turn")))
    gathered = earlier.groupBy("session_id", "asked_turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line_no").isNotNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("context")
    )
    known = F.concat(F.lit("Known so far\n"), F.col("context"), F.lit("\nNow asked\n"), F.col("question"))
    return wanted.join(gathered, ["session_id", "asked_turn"], "left").select(
        "session_id", F.col("asked_turn").alias("turn"), F.when(F.coalesce("context", F.lit("")) == "", F.col("question")).otherwise(known).alias("prompt")
    )


def follow_up_question(lines: DataFrame, session_id: str, turn: int, question: str) -> str:
    """The question of one turn, preceded by the findings of earlier turns."""
    earlier = lines.where((F.col("session_id") == session_id) & (F.col("turn") < turn)).orderBy("line_no")
    context = "\n".join(row["line"] for row in earlier.select("line").collect())
    if not context:
        return question
    return f"Known so far\n{context}\nNow asked\n{question}"
