"""Card catalogue and puzzle answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_cards(cards: DataFrame, type: str | None = None, unit: int | None = None, grade: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of cards in file order (``pos``) with the total before paging; a falsy filter is none (unit 0 too)."""
    for column, value in (("type", type), ("unit", unit), ("grade", grade)):
        if value:
            cards = cards.where(F.col(column) == value)
    total = cards.agg(F.count("*").alias("total"))
    page = cards.orderBy("pos", "id").offset(offset).limit(limit).drop("puzzles")
    return page.join(F.broadcast(total))  # one row


def get_cards(cards: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first card of each requested id, and the ids that have none."""
    first = cards.groupBy("id").agg(F.min_by(F.struct("type", "unit", "grade"), "pos").alias("card"))
    return requests.join(first, "id").select("id", "card.*"), requests.join(first, "id", "left_anti").select("id")


def check_puzzles(cards: DataFrame, answers: DataFrame) -> DataFrame:
    """status, is_correct, wrong_indices and the right answer (if wrong) of each row of ``answers`` (puzzle_id, answer).

    The card is the puzzle id without its last part.  Status: INVALID_INPUT, CARD_NOT_FOUND, PUZZLE_NOT_FOUND or OK.
    """
    parts = F.split("puzzle_id", "_")
    asked = answers.withColumn("card_id", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "_"))
    known = cards.select(F.col("id").alias("card_id")).distinct().withColumn("known", F.lit(True))
    puzzles = cards.select(F.posexplode("puzzles").alias("n", "p"), "pos").select(F.col("p.id").alias("puzzle_id"), F.col("p.answer").alias("correct"), "pos", "n")
    first = puzzles.groupBy("puzzle_id").agg(F.min_by("correct", F.struct("pos", "n")).alias("correct"))
    rows = asked.join(known, "card_id", "left").join(first, "puzzle_id", "left")
    user, right = F.col("answer"), F.col("correct")
    valid = (F.coalesce(F.col("puzzle_id"), F.lit("")) != "") & (F.coalesce(F.size(user), F.lit(0)) > 0)
    status = F.when(~valid, "INVALID_INPUT").when(F.col("known").isNull(), "CARD_NOT_FOUND").when(right.isNull(), "PUZZLE_NOT_FOUND").otherwise("OK")
    shorter = F.least(F.size(user), F.size(right))
    differing = F.filter(F.transform(F.slice(user, 1, shorter), lambda u, i: F.when(u != F.get(right, i), i)), lambda i: i.isNotNull())
    wrong = F.concat(differing, F.when(F.size(user) != F.size(right), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    ok = F.col("status") == "OK"
    return rows.withColumn("status", status).select(
        "puzzle_id", "status", F.when(ok, user == right).alias("is_correct"), F.when(ok, wrong).alias("wrong_indices"), F.when(ok & (user != right), right).alias("correct_answer"))
