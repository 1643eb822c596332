"""Queries of the ledger engine over whole driver tables, and the SQL they are compared with.

An order is a project, its line items are bidder rows, suppliers are the companies; the cheapest line wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.functions.text import clean_udf, confidence_text, id_column, name_key_udf, needs_escape, similarity_udf
from ledgerloom.operators import windows
from ledgerloom.sources.scan import digests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_key(name) -> F.Column:
    """name_key() of plain ASCII names, without leaving the JVM."""
    return F.lower(F.regexp_replace(name, r"\s+", ""))


LINE = ("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their company, dealt by order: what follows per order or per company of an order needs no other
    exchange. Suppliers are joined by key, and sent out only where Catalyst sees that they are few."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE, "l_quantity", "l_returnflag")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("bidder"))
    return lines.join(names, "l_suppkey").withColumn("bidder_key", ascii_key("bidder")).repartition("l_orderkey")


BIDS = """bids AS (SELECT l.*, s_name AS bidder, lower(regexp_replace(s_name, '\\s+', '', 'g')) AS bidder_key
 FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One participant for each company of an order: first spelling, mentions, conflicts, reconciled status."""
    place = F.struct(*LINE)
    stated = F.when(F.col("l_returnflag") == "A", V.YES).when(F.col("l_returnflag") == "R", V.NO)
    out = bids(spark, sf_dir).groupBy("l_orderkey", "bidder_key").agg(
        F.min_by("bidder", place).alias("bidder"), F.min_by("l_extendedprice", place).alias("price"), F.min("l_linenumber").alias("first_line"), F.count("*").alias("mentions"),
        F.min(F.struct("l_extendedprice", *LINE[:3])).alias("cheapest"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.min("l_quantity").alias("q_low"), F.max("l_quantity").alias("q_high"), F.min(stated).alias("s_low"), F.max(stated).alias("s_high"),
    )
    status = F.when(F.col("s_low") == F.col("s_high"), F.col("s_low")).otherwise("")
    return out.withColumns({"price_conflict": F.col("low") != F.col("high"), "quantity_conflict": F.col("q_low") != F.col("q_high"), "status_conflict": F.coalesce(F.col("s_low") != F.col("s_high"), F.lit(False)), "stated": F.coalesce(status, F.lit(""))})


RECORDS = f"""{BIDS}, rec0 AS (SELECT l_orderkey, bidder_key, first(bidder ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS bidder,
 first(l_extendedprice ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS price, min(l_linenumber) AS first_line, count(*) AS mentions,
 count(DISTINCT l_extendedprice) > 1 AS price_conflict, count(DISTINCT l_quantity) > 1 AS quantity_conflict,
 count(DISTINCT CASE l_returnflag WHEN 'A' THEN '是' WHEN 'R' THEN '否' END) AS ns, min(CASE l_returnflag WHEN 'A' THEN '是' WHEN 'R' THEN '否' END) AS s
 FROM bids GROUP BY ALL),
rec AS (SELECT * EXCLUDE (ns, s), ns > 1 AS status_conflict, CASE WHEN ns = 1 THEN s ELSE '' END AS stated FROM rec0)"""


@query(f"WITH {RECORDS} SELECT * FROM rec")
def group_dedup(spark, sf_dir):
    """Participants of each order, once for each company."""
    return records(spark, sf_dir).drop("cheapest", "low", "high", "q_low", "q_high", "s_low", "s_high")


@query(f"""WITH {RECORDS} SELECT l_orderkey, bidder_key, concat_ws(',', CASE WHEN status_conflict THEN 'award_status' END, CASE WHEN price_conflict THEN 'bidder_price' END, CASE WHEN quantity_conflict THEN 'quantity' END) AS fields
FROM rec WHERE price_conflict OR quantity_conflict OR status_conflict""")
def field_conflicts(spark, sf_dir):
    """Fields in which the mentions of one company differ."""
    names = {"status_conflict": "award_status", "price_conflict": "bidder_price", "quantity_conflict": "quantity"}
    return records(spark, sf_dir).where(" or ".join(names)).select("l_orderkey", "bidder_key", F.concat_ws(",", *[F.when(F.col(c), n) for c, n in names.items()]).alias("fields"))


def sizes(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("mentions").alias("declared"), F.count("*").alias("actual"))


@query(f"WITH {RECORDS} SELECT l_orderkey, CAST(sum(mentions) AS BIGINT) AS declared, count(*) AS actual FROM rec GROUP BY l_orderkey HAVING sum(mentions) <> count(*)")
def count_mismatch(spark, sf_dir):
    """Orders whose declared number of bids is not the number of companies."""
    return sizes(spark, sf_dir).where("declared <> actual")


def awarded(spark, sf_dir) -> DataFrame:
    """Participants with the cheapest line of their order, and whether it is theirs. Rows are dealt by order already, so that
    the window needs no exchange and no join."""
    best = F.min(F.struct("cheapest", "bidder_key")).over(Window.partitionBy("l_orderkey"))
    found = records(spark, sf_dir).withColumn("best", best)
    return found.withColumns({"award_price": F.col("best.cheapest.l_extendedprice"), "won": F.col("best.bidder_key") == F.col("bidder_key")}).drop("best")


AWARDS = """awards AS (SELECT l_orderkey, first(bidder_key ORDER BY l_extendedprice, l_linenumber, l_suppkey, l_partkey) AS bidder_key, min(l_extendedprice) AS award_price FROM bids GROUP BY l_orderkey)"""


@query(f"WITH {RECORDS}, {AWARDS} SELECT l_orderkey, bidder_key, bidder, first_line, award_price FROM rec JOIN awards USING (l_orderkey, bidder_key)")
def award_exact_match(spark, sf_dir):
    """Awards and the participants that carry exactly their name."""
    return awarded(spark, sf_dir).where("won").select("l_orderkey", "bidder_key", "bidder", "first_line", "award_price")


def statuses(spark, sf_dir) -> DataFrame:
    """Award status: winners by match; losers only where the order is complete (status F); stated values override blanks."""
    complete = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.max(F.col("o_orderstatus") == "F").alias("complete"))
    out = awarded(spark, sf_dir).join(complete, "l_orderkey", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    out = out.withColumn("derived", F.when(F.col("won"), V.YES).when(F.col("complete"), V.NO).otherwise(""))
    clash = (F.col("stated") != "") & (F.col("derived") != "") & (F.col("stated") != F.col("derived"))
    return out.withColumns({"clash": clash, "award_status": F.when(clash | F.col("status_conflict"), "").when(F.col("stated") != "", F.col("stated")).otherwise(F.col("derived"))})


STATUS = f"""{RECORDS}, {AWARDS}, complete AS (SELECT o_orderkey AS l_orderkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AS complete FROM orders GROUP BY 1),
st0 AS (SELECT rec.*, awards.bidder_key IS NOT NULL AS won, coalesce(complete, false) AS complete FROM rec
 LEFT JOIN awards ON awards.l_orderkey = rec.l_orderkey AND awards.bidder_key = rec.bidder_key LEFT JOIN complete ON complete.l_orderkey = rec.l_orderkey),
st1 AS (SELECT *, CASE WHEN won THEN '是' WHEN complete THEN '否' ELSE '' END AS derived FROM st0),
st2 AS (SELECT *, stated <> '' AND derived <> '' AND stated <> derived AS clash FROM st1),
st AS (SELECT *, CASE WHEN clash OR status_conflict THEN '' WHEN stated <> '' THEN stated ELSE derived END AS award_status FROM st2)"""


@query(f"WITH {STATUS} SELECT l_orderkey, bidder_key, award_status, clash FROM st")
def status_derivation(spark, sf_dir):
    """Award status of every participant, and where the sources contradict each other."""
    return statuses(spark, sf_dir).select("l_orderkey", "bidder_key", "award_status", "clash")


@query(f"""WITH {STATUS} SELECT l_orderkey, bidder_key, rtrim(rtrim(printf('%.2f', least(0.88, CASE WHEN won THEN 1.0 WHEN award_status = '否' THEN 0.9 WHEN award_status <> '' THEN 1.0 ELSE 0.6 END, CASE WHEN clash OR price_conflict OR status_conflict THEN 0.6 ELSE 1.0 END)), '0'), '.') AS confidence FROM st""")
def confidence(spark, sf_dir):
    """Rule reliability: the least of grouping and award mapping, 0.60 where an issue relates."""
    award = F.when(F.col("won"), 1.0).when(F.col("award_status") == V.NO, 0.9).when(F.col("award_status") != "", 1.0).otherwise(0.6)
    issue = F.when(F.col("clash") | F.col("price_conflict") | F.col("status_conflict"), 0.6).otherwise(1.0)
    return statuses(spark, sf_dir).select("l_orderkey", "bidder_key", confidence_text(F.least(F.lit(V.GROUPING_SCORES["project"]), award, issue)).alias("confidence"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM events""")
def forward_fill_blocks(spark, sf_dir):
    """Each event with the sign-up it follows."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.forward_fill(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "block").select("event_id", "user_id", "block")


@query("""WITH s AS (SELECT *, sum(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM s GROUP BY ALL""")
def anchor_sessions(spark, sf_dir):
    """Groups that run from one anchor row to the next."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    marked = windows.sessions(events, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("signup", "purchase"))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@query("""WITH d AS (SELECT DISTINCT event_type, event_id FROM events), i AS (SELECT *, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM d)
SELECT event_type, min(event_id) AS "start", max(event_id) AS "end" FROM i GROUP BY event_type, k""")
def regions(spark, sf_dir):
    """Content regions: runs of consecutive ids of one type."""
    return windows.islands(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@query(r"""SELECT md5(replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss')) AS k, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def name_key_dedup(spark, sf_dir):
    """Texts that are one spelling of another, by the Unicode-exact key."""
    keyed = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(name_key_udf("text")).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query(r"""SELECT 'd' AS kind, doc_id AS id, 0 AS turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents
UNION ALL SELECT 'c', conv_id, turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) FROM conversations""")
def clean_text(spark, sf_dir):
    """Normalised texts of documents and conversations."""
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"), "text")
    return docs.union(turns).select("kind", "id", "turn", F.md5(clean_udf("text")).alias("cleaned"))


@query(r"""SELECT doc_id, CAST(i AS INT) AS idx, md5(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE trim(line) <> ''""")
def split_lines(spark, sf_dir):
    """Fragments of list cells, numbered by their place in the cell."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.where("trim(line) <> ''").select("doc_id", (F.col("i") + 1).alias("idx"), F.md5("line").alias("line"))


@query()
def top3_candidates(spark, sf_dir):
    """For the best-funded supplier of each nation, the three likeliest names among the nation's suppliers."""
    s = table(spark, sf_dir, "supplier")
    awards = s.groupBy("s_nationkey").agg(F.max_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("award"))
    scored = s.join(awards, "s_nationkey").select("s_nationkey", "s_suppkey", "s_name", "award", similarity_udf("award", "s_name")["score"].alias("score"))
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("score"), "s_suppkey")
    return scored.withColumn("place", F.row_number().over(w)).where("place <= 3")


CELL = 64


@query("""SELECT p_partkey, count(o_orderkey) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM part LEFT JOIN orders ON o_orderkey BETWEEN p_partkey * 10 AND p_partkey * 10 + p_size GROUP BY p_partkey""")
def interval_merge_join(spark, sf_dir):
    """Points in intervals: both sides are cut into cells of fixed width, so that the join has an equality."""
    spans = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 10).alias("top"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("bottom"))
    cut = spans.withColumn("cell", F.explode(F.sequence(F.expr(f"top div {CELL}"), F.expr(f"bottom div {CELL}"))))
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"o_orderkey div {CELL}").alias("cell"))
    hit = cut.join(points, "cell").where("o_orderkey between top and bottom").groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    return spans.select("p_partkey").join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), "low", "high")


@query("""WITH s AS (SELECT p_partkey, p_partkey * 10 AS a, p_partkey * 10 + p_size AS b FROM part) SELECT x.p_partkey AS one, y.p_partkey AS other FROM s x JOIN s y ON x.p_partkey < y.p_partkey AND x.a <= y.b AND y.a <= x.b""")
def overlapping_ranges(spark, sf_dir):
    """Ranges that overlap: each pair is found in the first cell that both touch."""
    s = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 10).alias("a"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("b"))
    cut = s.withColumn("cell", F.explode(F.sequence(F.expr(f"a div {CELL}"), F.expr(f"b div {CELL}"))))
    x, y = cut.alias("x"), cut.alias("y")
    pairs = x.join(y, F.expr(f"x.cell = y.cell and x.p_partkey < y.p_partkey and x.a <= y.b and y.a <= x.b and x.cell = greatest(x.a, y.a) div {CELL}"))
    return pairs.select(F.col("x.p_partkey").alias("one"), F.col("y.p_partkey").alias("other"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pending(spark, sf_dir):
    """What is still undecided."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, 'unlabelled' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def coverage_missing(spark, sf_dir):
    """Both differences of two key sets."""
    d, n = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.distinct().join(n, "doc_id", "left_anti").withColumn("side", F.lit("unlabelled")).union(n.distinct().join(d, "doc_id", "left_anti").withColumn("side", F.lit("unknown")))


@query(f"WITH {BIDS} SELECT bidder_key, first(bidder ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS bidder, min(l_orderkey) AS first_order FROM bids GROUP BY bidder_key")
def unique_companies(spark, sf_dir):
    """Each company once, in its first spelling."""
    place = F.struct("l_orderkey", *LINE[:3])
    return bids(spark, sf_dir).groupBy("bidder_key").agg(F.min_by("bidder", place).alias("bidder"), F.min("l_orderkey").alias("first_order"))


@query(f"""WITH {STATUS} SELECT count(*) AS record_count, count(DISTINCT l_orderkey) AS group_count, count(DISTINCT bidder_key) AS unique_company_count, CAST(sum(mentions - 1) AS BIGINT) AS duplicate_mentions_removed,
count(*) FILTER (WHERE award_status = '是') AS winners, count(*) FILTER (WHERE award_status = '否') AS losers, count(*) FILTER (WHERE price_conflict OR status_conflict OR clash) AS pending_record_count FROM st""")
def summary_counters(spark, sf_dir):
    """The counters of a result, in one pass."""
    return statuses(spark, sf_dir).agg(
        F.count("*").alias("record_count"), F.count_distinct("l_orderkey").alias("group_count"), F.count_distinct("bidder_key").alias("unique_company_count"), F.sum(F.col("mentions") - 1).alias("duplicate_mentions_removed"),
        F.count_if(F.col("award_status") == V.YES).alias("winners"), F.count_if(F.col("award_status") == V.NO).alias("losers"), F.count_if(F.col("price_conflict") | F.col("status_conflict") | F.col("clash")).alias("pending_record_count"),
    )


def review_rows(spark, sf_dir) -> DataFrame:
    flagged = records(spark, sf_dir).where("price_conflict").select(F.lit(0).alias("level"), "l_orderkey", "first_line", "bidder_key")
    orders = sizes(spark, sf_dir).where("declared <> actual").select(F.lit(1).alias("level"), "l_orderkey", F.lit(0).alias("first_line"), F.lit("").alias("bidder_key"))
    return windows.numbered(flagged.union(orders), ["level", "l_orderkey", "first_line", "bidder_key"], "seq")


@query(f"""WITH {RECORDS}, q AS (SELECT 0 AS level, l_orderkey, first_line, bidder_key FROM rec WHERE price_conflict
UNION ALL SELECT 1, l_orderkey, 0, '' FROM rec GROUP BY l_orderkey HAVING sum(mentions) <> count(*))
SELECT *, row_number() OVER (ORDER BY level, l_orderkey, first_line, bidder_key) AS seq FROM q""")
def review_queue(spark, sf_dir):
    """Flagged records in order, then standalone issues, densely numbered without a single-task window."""
    return review_rows(spark, sf_dir)


@query(f"WITH {STATUS} SELECT l_orderkey, bidder_key, bidder FROM st WHERE clash ORDER BY l_orderkey, first_line, bidder_key LIMIT 5")
def question_batch(spark, sf_dir):
    """The next five questions (the size of a batch is the feature)."""
    return statuses(spark, sf_dir).where("clash").orderBy("l_orderkey", "first_line", "bidder_key").limit(V.QUESTIONS).select("l_orderkey", "bidder_key", "bidder")


@query(r"SELECT doc_id, regexp_matches(text, '^\s*[=+@-]') AS escaped, md5(CASE WHEN regexp_matches(text, '^\s*[=+@-]') THEN chr(39) || text ELSE text END) AS exported FROM documents WHERE text IS NOT NULL")
def csv_escape(spark, sf_dir):
    """Texts as they are exported: what a spreadsheet would run is quoted."""
    risky = needs_escape(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", risky.alias("escaped"), F.md5(F.when(risky, F.concat(F.lit("'"), "text")).otherwise(F.col("text"))).alias("exported"))


PROFILED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("SELECT col, count(v) AS nonempty, count(*) FILTER (WHERE v IS NULL) AS empty, min(v) AS low, max(v) AS high FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM lineitem" for c in PROFILED) + ") GROUP BY col")
def column_profile(spark, sf_dir):
    """Content counts and sample values of each column, in one scan."""
    cells = table(spark, sf_dir, "lineitem").select(F.expr(f"stack({len(PROFILED)}, " + ", ".join(f"'{c}', cast({c} as string)" for c in PROFILED) + ") as (col, v)"))
    return cells.groupBy("col").agg(F.count("v").alias("nonempty"), F.count_if(F.col("v").isNull()).alias("empty"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("""SELECT o_orderkey, 'project_' || substr(sha256('["' || o_orderkey || '","' || o_orderstatus || '","' || o_orderpriority || '"]'), 1, 24) AS id FROM orders""")
def stable_ids(spark, sf_dir):
    """Deterministic ids of orders, from their parts as compact JSON."""
    return table(spark, sf_dir, "orders").select("o_orderkey", id_column("project", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("id"))


@query()
def source_scan(spark, sf_dir):
    """Files of all tables with size and digest, without decoding them."""
    return digests(spark, f"{sf_dir}/*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", "sha256")


@query(f"""WITH {RECORDS} SELECT 'record without order' AS rule, count(*) AS broken FROM rec WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'line without supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'record listed twice', count(*) FROM (SELECT 1 FROM rec GROUP BY l_orderkey, bidder_key HAVING count(*) > 1)""")
def integrity_checks(spark, sf_dir):
    """Referential rules as anti-joins: each must find nothing."""
    rec, orders = records(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lost = table(spark, sf_dir, "lineitem").select("l_suppkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_anti")
    rules = [("record without order", rec.join(orders, "l_orderkey", "left_anti")), ("line without supplier", lost), ("record listed twice", rec.groupBy("l_orderkey", "bidder_key").count().where("count > 1"))]
    out = None
    for name, found in rules:
        one = found.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N", count(*) FILTER (WHERE l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def role_pivot(spark, sf_dir):
    """Rows to columns with a fixed list of roles: one pass, no scan for the values."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return counted.fillna(0, ["A", "N", "R"])


@query("""SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS cells FROM lineitem WHERE l_orderkey BETWEEN 100 AND 199 GROUP BY 1""")
def row_view(spark, sf_dir):
    """A bounded row range as texts (the range is the feature); the filter reaches the scan."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey between 100 and 199")
    cells = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(cells, lambda c: F.concat(c["l_linenumber"].cast("string"), F.lit(":"), c["l_returnflag"])), ",").alias("cells"))


@query(f"""WITH {BIDS}, n AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM bids GROUP BY ALL), g AS (SELECT l_orderkey, max(n) AS most, count(*) AS rows FROM n GROUP BY 1)
SELECT l_orderkey, most = 1 AS safe, rows FROM g""")
def row_safety(spark, sf_dir):
    """Orders in which every row has one bidder, so that a row's award may be recommended to it."""
    rows = bids(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return rows.groupBy("l_orderkey").agg((F.max("n") == 1).alias("safe"), F.count("*").alias("rows"))


@query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '；' ORDER BY l_returnflag) AS reasons FROM lineitem GROUP BY 1""")
def distinct_reasons(spark, sf_dir):
    """Distinct messages of a group in one text."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "；").alias("reasons"))


@query("""SELECT n_name AS project, s_name AS company, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1 THEN '是' ELSE '否' END AS award_status,
CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1 THEN '0.95' ELSE '0.9' END AS confidence, '通过' AS review FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def ledger_result(spark, sf_dir):
    """The whole engine over a ledger of suppliers: a sheet for each nation, a bidder row for each supplier."""
    from ledgerloom.plans.suppliers import supplier_ledger

    final = supplier_ledger(spark, table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")).final
    return final.select(F.col("项目名称").alias("project"), F.col("公司名称").alias("company"), F.col("中标与否").alias("award_status"), F.col("置信度").alias("confidence"), F.col("复核状态").alias("review"))
