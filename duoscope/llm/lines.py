"""Line dedup: an exact set-similarity join of lines, with DataFrame functions only.

A line's tokens are the set of its five-word shingles (a line of fewer words: the whole sequence), of lower-cased words. A line goes if an earlier
line has Jaccard similarity 4/5 or more with it; whether that line itself stays does not matter. Lines are ordered by id, then (for rows that repeat
an id) by the text's digest, then by number in the text.

1. Equal lines form classes that stand for their first line.
2. Two lines with similarity 4/5 share a token among the first n - ceil(4n/5) + 1 of each, whatever the fixed order of tokens, and k tokens (or
   all that they must share) among k - 1 more; a first pass takes them by hash and leaves out classes with fewer tokens that others have there.
3. The tokens of the other classes are counted exactly. A class with more tokens of its own alone than a similar one can lack is left out.
4. The tokens of what is left are ordered by rarity and cut to the prefix. Each class is first tried with the earliest class of each of its
   tokens, which settles most members of a group of near copies in linear time; what is not settled is tried with the other classes whose size
   and position in the token's list allow it.
5. A pair passes the length filter and the positional filter at its first common token: no more can be shared than what follows there. Pairs that
   pass are verified on whole token sets.

Null texts have no lines; lines without words are no lines and always stay. Null ids are one id that sorts first. Rows that repeat an id are told
apart by their texts; of rows that repeat id and text one is taken as the first, whichever, and the lines of the others go. Long lines are taken whole.
Empty tables give empty results. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.runtime import discard, materialize

SHINGLE = 5
#: Similarity as a fraction.
OVER, UNDER = 4, 5
#: Tokens that a pair must share in the first pass.
MEET = 4
FILTER_BITS = 24
_SPACE = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]+"


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE)) != ""


def tie(text_col: str) -> Column:
    """Orders rows that repeat an id: the first 15 digits of the text's digest."""
    return F.conv(F.substring(F.md5(F.col(text_col).cast("string")), 1, 15), 16, 10).cast("long")


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_, tie, line_no, line): all lines.

    Here and below the outer forms of explode keep Spark from filtering by the array's size, which would make the array twice.
    """
    rows = docs.select(F.col(id_col).alias("id_"), tie(text_col).alias("tie"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))  # once a text
    return rows.select("id_", "tie", F.posexplode_outer("lines").alias("line_no", "line"))


def shingle_sets(df: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Column l becomes s, the set of its shingles' hashes: words are hashed once each, a shingle's hash is that of its words' hashes."""
    l = F.col("l")
    odd = l.contains("\t") | l.contains("\x0b") | l.contains("\x0c") | l.contains("\r")
    plain = F.array_remove(F.split(l, " "), "")  # cheaper
    words = df.withColumn("w_", F.when(odd, F.regexp_extract_all(l, F.lit(_WORD), F.lit(0))).otherwise(plain)).withColumn("w_", F.transform("w_", lambda x: F.xxhash64(x)))
    several = F.transform(F.sequence(F.lit(0), F.size("w_") - k), lambda i: F.xxhash64(*[F.get("w_", i + j) for j in range(k)]))
    return words.withColumn("s", F.when(F.size("w_") >= k, F.array_distinct(several)).otherwise(F.array(F.xxhash64("w_")))).drop("w_")


def needed(n: Column) -> Column:
    """ceil(OVER n / UNDER)."""
    return F.floor((n * OVER + (UNDER - 1)) / UNDER).cast("int")


def prefix_size(n: Column) -> Column:
    return n - needed(n) + 1


def may_match(a: str, b: str) -> Column:
    """The length filter, and the positional filter for a pair that meets at its first common token."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (na * UNDER >= nb * OVER) & (nb * UNDER >= na * OVER) & (left * (OVER + UNDER) >= (na + nb) * OVER)


def bit_of(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def marks(hashes: DataFrame) -> Column:
    """A bit set of the hashes (h), of fixed size: a scalar column to filter by before a shuffle."""
    words = hashes.select(bit_of(F.col("h")).alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("x"))
    every = hashes.sparkSession.range(1 << (FILTER_BITS - 6)).select(F.col("id").cast("int").alias("i")).join(words, "i", "left").select("i", F.coalesce("x", F.lit(0).cast("long")).alias("x"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])).scalar()


def marked(bits: Column, h: Column) -> Column:
    return F.getbit(F.get(bits, F.shiftright(bit_of(h), 6).cast("int")), bit_of(h).bitwiseAND(F.lit(63)).cast("int")) == 1


def line_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, id_, tie, line_no, n, cut): classes of equal lines with their first line, the size of its token set and its first tokens by hash."""
    lines = split_lines(docs, id_col, text_col).filter(has_word(F.col("line")))
    sets = shingle_sets(lines.select("id_", "tie", "line_no", F.lower("line").alias("l")).withColumn("h1", F.xxhash64("l")).withColumn("h2", F.xxhash64(F.lit(1), "l")))
    n = F.size("s")
    cut = F.slice(F.sort_array("s"), F.lit(1), prefix_size(n) + (MEET - 1))
    first = sets.select("h1", "h2", F.struct("id_", "tie", "line_no", n.alias("n"), cut.alias("cut")).alias("first")).groupBy("h1", "h2").agg(F.min("first").alias("first"))
    return materialize(first.select(F.monotonically_increasing_id().alias("cls"), "first.*"), "classes")


def several_times(tokens: DataFrame, name: str) -> DataFrame:
    """(token, many) for tokens that occur twice or more. Counts are summed before the shuffle, so no token is hot."""
    return materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), name)


def met_classes(classes: DataFrame) -> DataFrame:
    """(cls, key): the classes of which others have enough of the first tokens."""
    tokens = several_times(classes.select(F.explode_outer("cut").alias("token")), "tokens")
    bits = marks(tokens.select(F.col("token").alias("h")))
    enough = F.least(F.lit(MEET), needed(F.col("n")))
    rows = classes.select("cls", enough.alias("enough"), F.explode_outer("cut").alias("token")).filter(marked(bits, F.col("token")))
    rows = rows.join(tokens.select("token"), "token").groupBy("cls", "enough").agg(F.count(F.lit(1)).alias("c")).filter("c >= enough").select("cls")
    met = materialize(classes.select("cls", F.struct("id_", "tie", "line_no").alias("key")).join(rows, "cls"), "met")
    discard(tokens)
    return met


def sets_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(cls, key, n, s): whole token sets of the wanted classes (cls, key), from their first lines."""
    bits = marks(wanted.select(F.xxhash64("key").alias("h")))
    lines = split_lines(docs, id_col, text_col).select(F.struct("id_", "tie", "line_no").alias("key"), "line")  # structs are equal where nulls in them are
    once = lines.filter(marked(bits, F.xxhash64("key"))).join(wanted, "key").groupBy("cls").agg(F.first("key").alias("key"), F.first("line").alias("line"))
    return materialize(shingle_sets(once.withColumn("l", F.lower("line"))).select("cls", "key", F.size("s").alias("n"), "s"), "sets")


def by_rarity(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets: those of the classes that may have a similar one; rare: (token, own), their first tokens by exact count, without those of one class only)."""
    tokens = several_times(sets.select(F.explode("s").alias("token")), "counts")
    bits = marks(tokens.select(F.col("token").alias("h")))
    common = sets.select("cls", "n", F.explode("s").alias("token")).filter(marked(bits, F.col("token"))).groupBy("cls", "n").agg(F.count(F.lit(1)).alias("c"))
    near = common.filter(F.col("n") - F.col("c") < prefix_size(F.col("n"))).select("cls")
    left = materialize(sets.join(near, "cls", "left_semi"), "left")
    several = left.select("cls", F.explode("s").alias("token")).join(tokens, "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("many", "token"))).alias("t"))
    alone = F.col("n") - F.size("t")  # the tokens of this class only come first
    cut = F.slice("t", F.lit(1), F.greatest(prefix_size(F.col("n")) - alone, F.lit(0)))
    prefix = left.select("cls", "key", "n").join(several, "cls").select("cls", "key", "n", alone.alias("alone"), F.posexplode(cut).alias("at", "t"))
    rare = materialize(prefix.select(F.col("t.token").alias("token"), F.struct("cls", "key", "n", (F.col("alone") + F.col("at")).alias("pos")).alias("own")), "rare")
    discard(tokens)
    return left, rare


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs of own and other as (later, earlier) with each pair once."""
    later = F.col("own.key") > F.col("other.key")
    pick = lambda a, b: F.when(later, F.col(f"{a}.cls")).otherwise(F.col(f"{b}.cls"))
    return pairs.select(pick("own", "other").alias("later"), pick("other", "own").alias("earlier")).distinct()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls): the later ones of pairs (later, earlier) that are similar."""
    left = pairs.join(sets.select(F.col("cls").alias("later"), F.col("s").alias("a")), "later")
    both = left.join(sets.select(F.col("cls").alias("earlier"), F.col("s").alias("b")), "earlier")
    same = F.size(F.array_intersect("a", "b"))
    return both.filter(same * (OVER + UNDER) >= (F.size("a") + F.size("b")) * OVER).select(F.col("later").alias("cls")).distinct()


def other_pairs(rare: DataFrame, settled: DataFrame) -> DataFrame:
    """(later, earlier) for the classes that are not settled. Of a pair the larger class, by size, looks for the smaller one.

    The smaller can be met only where 8/9 of its tokens are left, in a band of sizes that a factor of 5/4 spans.
    """
    n, left = F.col("own.n"), F.col("own.n") - F.col("own.pos")
    band = lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(UNDER / OVER)) + F.lit(1e-9)).cast("int")
    rows = rare.join(settled.withColumn("done", F.lit(True)), rare["own"]["cls"] == settled["cls"], "left").select("token", "own", F.col("done").isNull().alias("open"))
    index = rows.filter(left * (OVER + UNDER) >= n * (2 * OVER)).select("token", band(n).alias("band"), F.col("own").alias("other"), F.col("open").alias("other_open"))
    probe = rows.select("token", F.explode(F.array(band(n), band(n) - 1)).alias("band"), "own", "open")
    one_way = (F.col("other.n") < F.col("own.n")) | ((F.col("other.n") == F.col("own.n")) & (F.col("other.cls") < F.col("own.cls")))
    same = (probe["token"] == index["token"]) & (probe["band"] == index["band"]) & one_way & may_match("own", "other")
    # only a pair whose later class is open matters, so open rows meet all rows, from either side; settled ones never meet each other
    own_later = probe.filter("open").join(index, same & (F.col("own.key") > F.col("other.key"))).select("own", "other")
    other_later = probe.join(index.filter("other_open"), same & (F.col("own.key") < F.col("other.key"))).select("own", "other")
    return ordered(own_later.unionByName(other_later))


def duplicate_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes, cls of those that go), both written."""
    classes = line_classes(docs, id_col, text_col)
    met = met_classes(classes)
    sets = sets_of(docs, id_col, text_col, met)
    discard(met)
    left, rare = by_rarity(sets)
    discard(sets)
    first = rare.groupBy("token").agg(F.min(F.struct("own.key", "own.cls", "own.n", "own.pos")).alias("other"))
    nearest = rare.join(first, "token").filter((F.col("own.cls") != F.col("other.cls")) & may_match("own", "other"))
    settled = materialize(similar(ordered(nearest), left), "settled")
    rest = materialize(similar(other_pairs(rare, settled), left), "rest")
    gone = materialize(settled.unionByName(rest), "gone")
    for done in (left, rare, settled, rest):
        discard(done)
    return classes, gone


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key_: id and tie, kept_: ascending numbers of the lines that stay), for rows with such lines; lines without words are not listed. Written."""
    classes, gone = duplicate_classes(docs, id_col, text_col)
    stay = classes.select("cls", "id_", "tie", "line_no").join(gone, "cls", "left_anti")
    kept = materialize(stay.groupBy(F.struct("id_", "tie").alias("key_")).agg(F.sort_array(F.collect_list("line_no")).alias("kept_")), "kept")
    discard(classes)
    discard(gone)
    return kept


def with_kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows (with key_) and kept_, null for rows without lines that stay. Of rows that repeat id and text the one met first has them."""
    numbered = rows.withColumn("place_", F.row_number().over(Window.partitionBy("key_").orderBy(F.lit(1))))
    mine = F.when(F.col("place_") == 1, F.col("kept_"))
    return numbered.join(kept, "key_", "left").withColumn("kept_", mine)


def row_key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id_"), tie(text_col).alias("tie")).alias("key_")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines (with words), n_kept, kept_lines (their numbers from 0, joined by commas)."""
    n = F.coalesce(F.size(F.filter(F.split(F.col(text_col).cast("string"), "\n"), has_word)), F.lit(0))
    rows = docs.select(row_key(id_col, text_col), F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long").alias("n_lines"))
    return with_kept(rows, kept_lines(docs, id_col, text_col)).select(
        F.col("key_.id_").alias(id_col), "n_lines", F.when(F.col("kept_").isNull(), 0).otherwise(F.size("kept_")).cast("long").alias("n_kept"), F.coalesce(F.array_join(F.col("kept_").cast("array<string>"), ","), F.lit("")).alias("kept_lines")
    )


def remove_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with later matches cut from their texts; a document of which no line with a word stays is left out.

    Documents that had no such line before stay as they are. length_col, if there, is made anew.
    """
    kept = kept_lines(docs, id_col, text_col)
    text = F.col(f"row_.{text_col}").cast("string")
    rows = docs.select(row_key(id_col, text_col), F.struct(*docs.columns).alias("row_"))  # no column that comes along can clash
    stays = F.transform(F.split(text, "\n"), lambda x, i: F.when(has_word(x) & ~F.array_contains("kept_", i), F.lit(None)).otherwise(x))
    had = F.coalesce(has_word(text), F.lit(False))
    cut = F.when(had, F.array_join(F.filter(stays, lambda x: x.isNotNull()), "\n")).otherwise(text)
    out = with_kept(rows, kept).filter(~had | F.col("kept_").isNotNull()).select("row_", cut.alias("cut_"))
    made = {text_col: F.col("cut_").cast(docs.schema[text_col].dataType)}
    if length_col in docs.columns:
        made[length_col] = F.length("cut_").cast(docs.schema[length_col].dataType)
    return out.select(*[made.get(c, F.col("row_")[c]).alias(c) for c in docs.columns])
