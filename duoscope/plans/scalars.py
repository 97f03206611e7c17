"""Scalar, text, time, hash and array functions, and the card arithmetic that is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.functions import cards as K
from duoscope.functions import scalar as S
from duoscope.operators import windows as W
from duoscope.plans import lens
from duoscope.plans.ordered import seconds
from duoscope.plans.registry import query
from duoscope.runtime import read

Spark = SparkSession


@query("SELECT c_custkey, greatest(c_acctbal, CASE WHEN c_nationkey > 10 THEN CAST(c_nationkey AS DOUBLE) END) AS hi, least(c_acctbal, CASE WHEN c_nationkey > 10 THEN CAST(c_nationkey AS DOUBLE) END) AS lo FROM customer")
def sc01_row_extremes(spark: Spark, sf: str) -> DataFrame:
    k = F.when(F.col("c_nationkey") > 10, F.col("c_nationkey").cast("double"))
    return read(spark, sf, "customer").select("c_custkey", F.greatest("c_acctbal", k).alias("hi"), F.least("c_acctbal", k).alias("lo"))


@query("SELECT c_custkey, round(coalesce(c_acctbal, 0) + coalesce(CASE WHEN c_nationkey > 10 THEN c_nationkey END, 0), 4) AS s FROM customer")
def sc02_row_sum(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", F.round(F.coalesce("c_acctbal", F.lit(0.0)) + F.coalesce(F.when(F.col("c_nationkey") > 10, F.col("c_nationkey")), F.lit(0)), 4).alias("s"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS DOUBLE) AS g, round(sqrt(abs(c_acctbal)), 6) AS r, round(ln(1 + abs(c_acctbal)), 6) AS l, round(exp(-abs(c_acctbal) / 1000), 9) AS e FROM customer")
def sc03_math(spark: Spark, sf: str) -> DataFrame:
    x = F.col("c_acctbal")
    return read(spark, sf, "customer").select("c_custkey", F.abs(x).alias("a"), F.signum(x).alias("g"), F.round(F.sqrt(F.abs(x)), 6).alias("r"), F.round(F.log1p(F.abs(x)), 6).alias("l"), F.round(F.exp(-F.abs(x) / 1000), 9).alias("e"))


@query("WITH " + lens.PAIRS_SQL + " SELECT pair_id, round(ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))), 6) AS o FROM pairs")
def sc04_log_odds(spark: Spark, sf: str) -> DataFrame:
    return lens.pairs(spark, sf).select("pair_id", F.round(S.log_odds(F.col("score")), 6).alias("o"))


@query("SELECT p_partkey, round(ln(exp(p_size / 10.0) + exp(p_retailprice / 1000.0)), 6) AS l FROM part")
def sc05_log_sum_exp(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.round(S.log_sum_exp([F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0]), 6).alias("l"))


@query("WITH " + lens.SCORES_SQL + " SELECT pair_id, hand, CASE WHEN s_directed_transfer >= s_soft_play AND s_directed_transfer >= s_coordinated_isolation THEN 'directed_transfer' WHEN s_soft_play >= s_coordinated_isolation THEN 'soft_play' ELSE 'coordinated_isolation' END AS family FROM hand_scores")
def sc06_arg_max(spark: Spark, sf: str) -> DataFrame:
    return lens.hand_scores(spark, sf).select("pair_id", "hand", S.arg_max({k: F.col(f"s_{k}") for k in ("directed_transfer", "soft_play", "coordinated_isolation")}).alias("family"))


@query("SELECT c_custkey, CAST(floor(c_acctbal / 7) AS BIGINT) AS q, ((c_nationkey - 12) % 6 + 6) % 6 AS m FROM customer")
def sc07_floor_modulo(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 7).alias("q"), F.pmod(F.col("c_nationkey") - 12, F.lit(6)).alias("m"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount / (l_tax + 1e-3), 4) AS r FROM lineitem WHERE l_quantity = 7")
def sc08_safe_ratio(spark: Spark, sf: str) -> DataFrame:
    from duoscope.functions.nulls import safe_ratio

    return read(spark, sf, "lineitem").filter("l_quantity = 7").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(safe_ratio(F.col("l_discount"), F.col("l_tax"), 1e-3), 4).alias("r"))


@query("SELECT p_partkey, CAST((p_retailprice >= 950) AS INTEGER) + CAST((p_retailprice >= 1000) AS INTEGER) + CAST((p_retailprice >= 1500) AS INTEGER) AS bin FROM part")
def sc09_digitize(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", S.digitize(F.col("p_retailprice"), [950, 1000, 1500]).alias("bin"))


@query("SELECT p_partkey, CAST((p_size >> 2) & 1 AS INTEGER) AS bit, CAST(bit_count(p_size) AS INTEGER) AS ones FROM part")
def sc10_bits(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.shiftright("p_size", 2).bitwiseAND(F.lit(1)).alias("bit"), F.bit_count("p_size").alias("ones"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def sc11_norm(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 5).alias("norm"))


@query("WITH " + lens.PAIRS_SQL + " SELECT pair_id, round(3 * score / (1 - score + 3 * score), 6) AS p FROM pairs")
def sc12_odds_rescale(spark: Spark, sf: str) -> DataFrame:
    return lens.pairs(spark, sf).select("pair_id", F.round(S.rescale_odds(F.col("score"), 3.0), 6).alias("p"))


@query("SELECT p_partkey, regexp_replace(CAST(CAST(round_even(p_size * 1.25, 1) AS DECIMAL(18,1)) AS VARCHAR), '\\.0$', '') AS t FROM part")
def sc13_one_decimal(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", S.one_decimal(F.col("p_size") * 1.25).alias("t"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS f, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS o, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS p FROM orders")
def sc14_one_hot(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", *[F.when(F.col("o_orderstatus") == s, 1.0).otherwise(0.0).alias(s.lower()) for s in "FOP"])


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 3 WHEN p_retailprice > 1000 THEN 2 WHEN p_size > 20 THEN 1 ELSE 0 END AS step FROM part")
def sc15_ladder(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 40, 3).when(F.col("p_retailprice") > 1000, 2).when(F.col("p_size") > 20, 1).otherwise(0).alias("step"))


@query("SELECT p_partkey, round(p_retailprice / 7, 2) AS r FROM part")
def sc16_round(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") / 7, 2).alias("r"))


@query("SELECT s_suppkey, substr(s_name, 1, 4) AS head, CAST(length(s_name) AS INTEGER) AS n, string_split(s_name, '#')[1] AS first, s_name || '/' || CAST(s_nationkey AS VARCHAR) AS joined FROM supplier")
def st20_slices(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").select("s_suppkey", F.substring("s_name", 1, 4).alias("head"), F.length("s_name").alias("n"), F.get(F.split("s_name", "#"), 0).alias("first"), F.concat("s_name", F.lit("/"), F.col("s_nationkey").cast("string")).alias("joined"))


@query("SELECT p_partkey, trim('  ' || p_type || ' ') AS t, lower(p_brand) AS b, starts_with(p_name, 'a') AS a FROM part")
def st21_strip_lower(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("t"), F.lower("p_brand").alias("b"), F.col("p_name").startswith("a").alias("a"))


@query("SELECT r_regionkey, CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:-2], ', ') || ', and ' || l[-1] END AS names FROM (SELECT n_regionkey AS r_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey)")
def st22_english_list(spark: Spark, sf: str) -> DataFrame:
    names = F.sort_array(F.collect_list("n_name"))
    return read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(names.alias("l")).select("r_regionkey", S.english_list(F.col("l")).alias("names"))


@query("SELECT p_partkey, CASE p_partkey % 13 WHEN 0 THEN 'two' WHEN 1 THEN 'three' WHEN 2 THEN 'four' WHEN 3 THEN 'five' WHEN 4 THEN 'six' WHEN 5 THEN 'seven' WHEN 6 THEN 'eight' WHEN 7 THEN 'nine' WHEN 8 THEN 'ten' WHEN 9 THEN 'jack' WHEN 10 THEN 'queen' WHEN 11 THEN 'king' ELSE 'ace' END || ' of ' || CASE p_partkey % 4 WHEN 0 THEN 'clubs' WHEN 1 THEN 'diamonds' WHEN 2 THEN 'hearts' ELSE 'spades' END AS card FROM part")
def st23_card_words(spark: Spark, sf: str) -> DataFrame:
    code = F.concat(F.substring(F.lit(K.RANKS), (F.col("p_partkey") % 13 + 1).cast("int"), F.lit(1)), F.substring(F.lit(K.SUITS), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)))
    return read(spark, sf, "part").select("p_partkey", K.words(code).alias("card"))


@query("WITH " + lens.ACTS_SQL + " SELECT hand, no, coalesce(string_agg(CAST(actor AS VARCHAR) || ' ' || act, '; ') OVER (PARTITION BY hand ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS story FROM acts")
def st24_narration(spark: Spark, sf: str) -> DataFrame:
    """What was done before, in order, for each decision."""
    said = F.concat(F.col("actor").cast("string"), F.lit(" "), "act")
    return lens.acts(spark, sf).select("hand", F.col("no").cast("long").alias("no"), F.array_join(F.collect_list(said).over(W.before(["hand"], ["no"])), "; ").alias("story"))


@query("SELECT event_id, CAST(epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS DOUBLE) AS s FROM events")
def dt01_seconds(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", (seconds("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00")).cast("double")).alias("s"))


@query("WITH " + lens.HANDS_SQL + " SELECT hand, row_number() OVER (PARTITION BY cust ORDER BY started, hand) - 1 AS t_rank FROM hands")
def dt02_time_rank(spark: Spark, sf: str) -> DataFrame:
    return lens.hands(spark, sf).select("hand", W.position(["cust"], ["started", "hand"]).cast("long").alias("t_rank"))


@query("SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1))::INTEGER & 1 AS INTEGER) AS half FROM orders".replace("CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1))::INTEGER & 1 AS INTEGER)", "CAST((strpos('0123456789abcdef', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1)) - 1) % 2 AS INTEGER)"))
def hs04_halves(spark: Spark, sf: str) -> DataFrame:
    """A fixed split of keys in halves by a hash that other engines have too."""
    digit = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 1), 16, 10).cast("int")
    return read(spark, sf, "orders").select("o_orderkey", (digit % 2).alias("half"))


@query()
def hs01_crc32_half(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", F.crc32(F.col("o_orderkey").cast("string").cast("binary")).bitwiseAND(F.lit(1)).alias("half"))


@query()
def hs02_table_parity(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").select("s_suppkey", F.pmod(F.xxhash64("s_nationkey"), F.lit(2)).alias("side"))


@query("SELECT p_partkey, md5(p_name) AS h FROM part")
def hs03_md5(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.md5(F.col("p_name").cast("binary")).alias("h"))


@query("SELECT vec_id, embedding[1] AS first, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))), 5) AS s FROM embeddings".replace("embedding[1] AS first", "CAST(embedding[1] AS DOUBLE) AS first"))
def ar01_lists(spark: Spark, sf: str) -> DataFrame:
    s = F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read(spark, sf, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("first"), F.size("embedding").alias("n"), F.round(s, 5).alias("s"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def ar02_combinations(spark: Spark, sf: str) -> DataFrame:
    from duoscope.operators.pairs import explode_pairs_array

    return explode_pairs_array(read(spark, sf, "nation"), "n_regionkey", "n_nationkey").select("a", "b")


_CARDS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 13 AS r1, (l_partkey // 13) % 4 AS u1, (l_suppkey * 5 + l_linenumber) % 13 AS r2, (l_suppkey + l_linenumber) % 4 AS u2 FROM lineitem"
_CHEN = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN hi = lo THEN greatest(2 * v, 5) ELSE v + CASE WHEN u1 = u2 THEN 2 ELSE 0 END - CASE WHEN gap <= 0 THEN 0 WHEN gap = 1 THEN 1 WHEN gap = 2 THEN 2 WHEN gap = 3 THEN 4 ELSE 5 END
 + CASE WHEN gap <= 1 AND hi < 10 THEN 1 ELSE 0 END END AS score FROM (SELECT *, hi - lo - 1 AS gap, CASE hi WHEN 12 THEN 10.0 WHEN 11 THEN 8.0 WHEN 10 THEN 7.0 WHEN 9 THEN 6.0 ELSE (hi + 2) / 2.0 END::DOUBLE AS v FROM (SELECT *, greatest(r1, r2) AS hi, least(r1, r2) AS lo FROM (""" + _CARDS + ")))"


def cards(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 13).alias("r1"), (F.floor(F.col("l_partkey") / 13) % 4).alias("u1"), ((F.col("l_suppkey") * 5 + F.col("l_linenumber")) % 13).alias("r2"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 4).alias("u2"))


@query(_CHEN)
def pk01_chen(spark: Spark, sf: str) -> DataFrame:
    return cards(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.chen(F.col("r1"), F.col("u1"), F.col("r2"), F.col("u2")).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_linenumber - l_suppkey % 6) % 6 + 6) % 6 AS pos FROM lineitem")
def pk02_position(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.pmod(F.col("l_linenumber") - F.col("l_suppkey") % 6, F.lit(6)).alias("pos"))


@query("SELECT p_partkey, CAST(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS INTEGER) AS n FROM part")
def pk03_board_size(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", K.board_size(F.col("p_name")).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_quantity > l_linenumber * 8) THEN 'aggressive' WHEN l_returnflag = 'A' THEN 'call' ELSE 'fold' END AS kind FROM lineitem")
def pk04_action_classes(spark: Spark, sf: str) -> DataFrame:
    """An all-in is a raise where its amount is over what there is to call, else a call."""
    act = F.when(F.col("l_returnflag") == "R", "raise").when(F.col("l_returnflag") == "A", "all_in").otherwise("fold")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.action_class(act, F.col("l_quantity"), F.col("l_linenumber") * 8).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / 10, 6) AS bb, round(least(greatest(l_quantity / greatest(l_linenumber * 3, 1), 0), 20), 6) AS of_pot FROM lineitem")
def pk05_normalised(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_quantity") / 10, 6).alias("bb"), F.round(K.of_pot(F.col("l_quantity"), F.col("l_linenumber") * 3), 6).alias("of_pot"))


@query("WITH " + lens.ACTS_SQL + """, x AS (SELECT *, (1 << CAST(actor % 6 AS INTEGER)) AS seat FROM acts) SELECT hand, no, CAST(coalesce(bit_or(seat) OVER w, 0) AS BIGINT) AS acted, CAST(coalesce(bit_or(CASE WHEN act = 'fold' THEN seat END) OVER w, 0) AS BIGINT) AS folded, count(*) FILTER (act = 'raise') OVER w AS raises,
 round(coalesce(sum(amount) OVER w, 0.0), 4) AS pot FROM x WINDOW w AS (PARTITION BY hand ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def pk13_causal_state(spark: Spark, sf: str) -> DataFrame:
    """The public state before each decision: who acted and folded as bit masks, raises, the pot."""
    return K.causal_state(lens.acts(spark, sf).withColumn("seat", (F.col("actor") % 6).cast("int"))).select("hand", F.col("no").cast("long").alias("no"), "acted", "folded", "raises", F.round("pot", 4).alias("pot"))


_BOARD = "SELECT p_partkey, [p_partkey % 13, (p_partkey * 7 + 3) % 13, (p_partkey * 11 + 5) % 13] AS r, [p_partkey % 4, (p_partkey // 4) % 4, (p_partkey // 16) % 4] AS u FROM part"


@query(f"SELECT p_partkey, CAST(list_max([len(list_filter(u, lambda x: x = 0)), len(list_filter(u, lambda x: x = 1)), len(list_filter(u, lambda x: x = 2)), len(list_filter(u, lambda x: x = 3))]) AS INTEGER) AS suit_max, len(list_distinct(r)) < 3 AS paired, CAST(list_max(r) AS INTEGER) AS high, CAST(list_max([len(list_distinct(list_filter(list_concat(r, list_transform(list_filter(r, lambda x: x = 12), lambda x: -1)), lambda x: x >= k AND x < k + 5))) FOR k IN range(-1, 9)]) AS INTEGER) AS straight FROM ({_BOARD})")
def pk14_board_texture(spark: Spark, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    r = F.array(p % 13, (p * 7 + 3) % 13, (p * 11 + 5) % 13)
    u = F.array(p % 4, F.floor(p / 4) % 4, F.floor(p / 16) % 4)
    t = K.texture(r, u)
    return read(spark, sf, "part").select("p_partkey", t["suit_max"].alias("suit_max"), t["paired"].alias("paired"), t["high"].alias("high"), t["straight"].alias("straight"))


@query("WITH " + lens.ACTS_SQL + ", x AS (SELECT *, sum(amount) OVER (PARTITION BY hand ORDER BY no) AS pot, o_totalprice AS stored FROM acts JOIN orders ON o_orderkey = hand) SELECT hand, count(*) AS n, count(*) FILTER (abs(pot - amount - before) > 0.01) AS wrong FROM (SELECT *, coalesce(lag(pot) OVER (PARTITION BY hand ORDER BY no), 0) AS before FROM x) GROUP BY hand")
def pk16_replay_check(spark: Spark, sf: str) -> DataFrame:
    """The running pot recomputed from exclusive sums against the inclusive ones: mismatches a hand."""
    a = lens.acts(spark, sf).withColumns({"pot": F.sum("amount").over(W.ordered(["hand"], ["no"])), "before": F.coalesce(F.sum("amount").over(W.before(["hand"], ["no"])), F.lit(0.0))})
    o = lens.hands(spark, sf).select("hand")
    return a.join(o, "hand").groupBy("hand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("pot") - F.col("amount") - F.col("before")) > 0.01).alias("wrong"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / (l_extendedprice + l_quantity + 1e-3), 8) AS odds, round(l_extendedprice / (l_quantity + 1e-3), 4) AS spr FROM lineitem")
def pk17_pot_odds(spark: Spark, sf: str) -> DataFrame:
    odds, spr = K.pot_odds(F.col("l_quantity"), F.col("l_extendedprice")), F.col("l_extendedprice") / (F.col("l_quantity") + 1e-3)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(odds, 8).alias("odds"), F.round(spr, 4).alias("spr"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, l_quantity - l_discount * 10 * (l_tax * 1000 + l_quantity)), 6) AS regret FROM lineitem")
def pk22_call_regret(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(K.call_regret(F.col("l_quantity"), F.col("l_tax") * 1000, F.col("l_discount") * 10), 6).alias("regret"))
