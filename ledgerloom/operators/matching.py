"""Awards to participants of the same group: exact names settle, likeness only recommends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import similarity_udf

SHOWN = 3
_SHOWN = "struct<order:double,record_id:string,name:string,name_similarity:double,core_similarity:double,score:double,same_row:boolean>"
REASONS = {
    "names": "按组内名称接近程度推荐",
    "list": "投标字段为名单或跨行合并，不能按同行推荐",
    "awards": "中标字段合并、含多家或重复展示，不能按同行推荐",
    "all_rows": "全部投标行均有中标字段，按组内名称推荐",
    "not_one": "中标行未唯一对应一家投标企业",
    "elsewhere": "中标名称精确对应组内其他行，不能按同行推荐",
    "safe": "中标信息与推荐投标企业位于同一行",
}


def award_cases(awards: DataFrame) -> DataFrame:
    """One case for each award name of a group, with all cells it stands in."""
    entry = F.struct("ord", "cell", "raw", "name", "award_row")
    cases = awards.groupBy("group_id", "key").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    cells = F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["cell"])))
    head = F.to_json(F.array("group_id", "key"))
    task = F.concat(F.lit("award_review_"), F.substring(F.sha2(F.concat(F.regexp_replace(head, r"\]$", ","), F.to_json(cells), F.lit("]")), 256), 1, 24))
    first = F.get("entries", F.lit(0))
    return cases.select("group_id", F.col("key").alias("award_key"), first["ord"].alias("ord"), first["raw"].alias("original_award"), first["name"].alias("award"), first["cell"].alias("award_cell"), first["award_row"].alias("award_row"), F.transform("entries", lambda e: e["cell"]).alias("award_cells"), task.alias("review_task_id"))


def scored_candidates(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Each case with each named participant of its group: an equality join on the group, likeness in Arrow batches."""
    people = records.where("name <> ''").select("group_id", F.col("record_id").alias("candidate"), F.col("name").alias("candidate_name"), F.col("key").alias("candidate_key"), F.transform("occurrences", lambda o: o["row"]).alias("rows"))
    pairs = cases.join(people, "group_id").withColumn("s", similarity_udf("award", "candidate_name"))
    return pairs.withColumns({"same_row": F.array_contains("rows", F.col("award_row")), "exact": F.col("candidate_key") == F.col("award_key"), "full": F.col("s.full"), "core": F.col("s.core"), "score": F.col("s.score")}).drop("s", "rows")


def with_places(scored: DataFrame) -> DataFrame:
    """scored with place: 1 for the likeliest of each case; ties go to the smaller id."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("review_task_id").orderBy(F.desc("score"), "candidate")))


def row_safety(groups: DataFrame, records: DataFrame, awards: DataFrame, summary: DataFrame) -> DataFrame:
    """Why, or why not, the participant in an award's row may be recommended: (group_id, safe, row_reason)."""
    seen = records.select("group_id", F.explode("occurrences").alias("o")).select("group_id", "o.row", "o.single")
    rows = seen.groupBy("group_id", "row").agg(F.count("*").alias("n"), F.min("single").alias("single")).groupBy("group_id").agg(F.max("n").alias("most"), F.min("single").alias("single"), F.collect_set("row").alias("rows"))
    prizes = awards.groupBy("group_id").agg(F.max(F.col("merged") | ~F.col("single_name")).alias("shared"), F.count("*").alias("n_all"), F.count_distinct("award_row").alias("n_rows"), F.count_distinct("key").alias("n_keys"), F.collect_set("award_row").alias("award_rows"))
    cases = summary.groupBy("group_id").agg(F.max(F.col("n_same") != 1).alias("not_one"), F.max("exact_elsewhere").alias("elsewhere"))
    g = groups.select("group_id", "award_mode", "company_role").join(prizes, "group_id").join(rows, "group_id", "left").join(cases, "group_id", "left")
    none = F.col("rows").isNull()
    why = (
        F.when((F.col("award_mode") == "name_match") | ~F.col("company_role").eqNullSafe("bidder_name"), "names")
        .when(~none & ((F.col("most") != 1) | ~F.col("single")), "list")
        .when(F.col("shared") | (F.col("n_rows") != F.col("n_all")) | (F.col("n_keys") != F.col("n_all")), "awards")
        .when((F.size(F.array_except(F.coalesce("rows", F.expr("cast(array() as array<int>)")), "award_rows")) == 0) & (F.col("award_mode") != "row_aligned"), "all_rows")
        .when(F.coalesce("not_one", F.lit(True)), "not_one")
        .when(F.coalesce("elsewhere", F.lit(False)), "elsewhere")
        .otherwise("safe")
    )
    text = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), why)
    return g.select("group_id", (why == "safe").alias("safe"), text.alias("row_reason"))


def match_awards(groups: DataFrame, records: DataFrame, awards: DataFrame, resolutions: dict[str, dict]) -> DataFrame:
    """A row for each case: status matched, unresolved or conflict; basis; selected and recommended participants.

    Of a case's candidates only the likeliest SHOWN, and the exact, the same-row and the decided one, are gathered."""
    spark = groups.sparkSession
    cases = award_cases(awards)
    chosen = [(k, r.get("record_id")) for k, r in resolutions.items() if r.get("decision") == "select_bidder"]
    decided = spark.createDataFrame(chosen, "review_task_id string, decided string").withColumn("has_decision", F.lit(True))
    cases = cases.join(decided, "review_task_id", "left")
    scored = with_places(scored_candidates(cases, records))
    shown = F.struct((-F.col("score")).alias("order"), F.col("candidate").alias("record_id"), F.col("candidate_name").alias("name"), F.col("full").alias("name_similarity"), F.col("core").alias("core_similarity"), "score", "same_row")
    one = lambda test: F.min(F.when(test, shown))
    summary = scored.groupBy("review_task_id").agg(
        F.count("*").alias("candidate_count"), F.count_if("exact").alias("n_exact"), F.count_if("same_row").alias("n_same"), one(F.col("exact")).alias("exact_one"), one(F.col("same_row")).alias("same_one"),
        one(F.col("candidate") == F.col("decided")).alias("decided_one"), one(F.col("place") == 1).alias("first_one"), F.array_sort(F.collect_list(F.when(F.col("place") <= SHOWN, shown))).alias("top"),
    )
    full = cases.join(summary, "review_task_id", "left").fillna(0, ["candidate_count", "n_exact", "n_same"])
    exact_id, same_id = F.col("exact_one.record_id"), F.col("same_one.record_id")
    full = full.withColumn("exact_elsewhere", (F.col("n_exact") > 0) & ((F.col("n_exact") > 1) | ~exact_id.eqNullSafe(same_id)))
    full = full.join(row_safety(groups, records, awards, full), "group_id", "left")
    by_name = F.col("n_exact") == 1
    by_user = (F.col("n_exact") == 0) & F.coalesce("has_decision", F.lit(False))
    known = F.col("decided_one").isNotNull()
    full = full.withColumns({
        "selected": F.when(by_name, F.col("exact_one")).when(by_user & known, F.col("decided_one")),
        "basis": F.when(by_name, "exact_name").when(by_user & known, "user_selection").otherwise("unresolved"),
        "clash": (F.col("n_exact") > 1) | (by_user & ~known),
    })
    claims = F.count("selected").over(Window.partitionBy("group_id", "selected.record_id"))
    by_row = F.coalesce("safe", F.lit(False)) & (F.col("n_same") == 1)
    full = full.withColumns({"clash": F.col("clash") | (F.col("selected").isNotNull() & (claims > 1)), "recommended": F.when(by_row, F.col("same_one")).otherwise(F.col("first_one")), "recommendation_basis": F.when(by_row, "same_row").otherwise("name_similarity")})
    applied = F.col("selected").isNotNull() & ~F.col("clash")
    also = F.array_sort(F.array_compact(F.array("selected", "recommended")))
    return full.select(
        "group_id", "ord", "review_task_id", "original_award", "award_cell", "award_cells", F.when(applied, "matched").when(F.col("clash"), "conflict").otherwise("unresolved").alias("status"), "basis",
        F.when(applied, F.col("selected.record_id")).alias("selected_record_id"), F.when(applied, F.col("selected.name")).alias("selected_bidder_name"), "candidate_count", F.array_distinct(F.concat(F.coalesce("top", F.array().cast(f"array<{_SHOWN}>")), also)).alias("candidates"),
        F.col("recommended.record_id").alias("recommended_record_id"), F.col("recommended.name").alias("recommended_bidder_name"), "recommendation_basis",
        F.when(F.col("recommendation_basis") == "same_row", F.col("row_reason")).otherwise("组内名称最接近").alias("recommendation_reason"), "safe", "row_reason",
    )
