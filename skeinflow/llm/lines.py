"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are what newlines separate; blank lines (spaces, tabs and carriage returns only) take no part and stay. A line goes if
the same text stood earlier, or, for lines of ``min_near`` characters or more, if a text within one edit (a character
inserted, deleted or replaced) has its first place earlier. Places are in order of (doc_id, line number), nulls
first.

1. Equal lines become one row, keyed by 128 bits of MD5, with their first place; partial aggregation takes the hot ones.
2. Lines that can't have a partner are left out by an exact filter. Let m be the shorter length of a pair within one edit and
   cut 0..m into s segments: the pair agrees in all that is left and right of one of them. So every line emits, for its own
   length and for one less, s hashes that leave one segment out, and a line whose hashes nobody shares has no partner. This
   runs with s = 2 on hashes alone, and with s = ``SEGMENTS`` on the texts that are left.
3. The lines left emit their deletion neighbourhood: the hash of the whole line, and of each text with one character less
   with the position of that character, within the segments whose hash they share. Lines that share hash and position differ by a replaced character; a line whose
   whole hash is another's variant differs by a deleted one. So a line meets only the earliest line of its (hash, position)
   and the one whole line of its hash, never all the others. ``levenshtein`` verifies the texts.
4. Numbers of lines to drop are gathered by document, and its text is put together from the rest.

Defined results: a null text stays null; an empty text stays empty; a document all of whose lines go keeps an empty text;
rows that repeat a doc_id share their places, so equal lines in one place stay alike; rows with a null doc_id take part as earliest;
other columns stay as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .filters import only_keys, split_by_keys
from .passing import hidden_pass
from .store import settle

MAX_EDITS = 1
MIN_NEAR_CHARS = 20
SEGMENTS = 32
HOT_SHARE = 1000
SALTS = 64


def _lines(docs: DataFrame) -> DataFrame:
    """(d, h, pos, line) of every line that is not blank; d is the doc_id, or the smallest long where it is null."""
    text = F.col("text").cast("string")
    # the hash is made below the generator, once for each text
    rows = docs.select(_id(F.col("doc_id")).alias("d"), text.alias("text"), F.xxhash64(text).alias("h")).where("text is not null")
    rows = rows.select("d", "h", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where("trim(LEADING ' \\t\\r' FROM line) <> ''")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long"))


def _key() -> Column:
    return F.unhex(F.md5("line"))


def _place() -> Column:
    """(d, pos) as one number in the same order, which a hash aggregation can keep the least of."""
    return (F.col("d").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("pos")).cast("decimal(33,0)")


def _hash_without(m: Column, j: Column, segments: int) -> Column:
    """The hash of ``line``, cut for the length m, without segment j."""
    n = F.length("line")
    left, right = F.floor(m * j / segments).cast("int"), m - F.floor(m * (j + 1) / segments).cast("int")
    return F.xxhash64(m, j, F.substring("line", F.lit(1), left), F.substring("line", n - right + 1, right))


def _hashes_without(m: Column, segments: int) -> Column:
    """For each segment of ``line`` (of length ``n``), cut for the length m, a hash of the others: those before it counted from
    the left and those after it from the right. Every segment is read once from either end; the rest is XOR of their hashes."""
    cut = lambda j: F.floor(m * j / segments).cast("int")
    part = lambda j, shift: F.xxhash64(m, j, F.substring("line", shift + cut(j) + 1, cut(j + 1) - cut(j)))
    each = lambda shift: F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda j: part(j, shift))
    sums = lambda parts: F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))
    before, after = (F.slice(sums(x), 1, segments) for x in (each(F.lit(0)), F.reverse(each(F.col("n") - m))))
    return F.zip_with(before, F.reverse(after), lambda x, y: x.bitwiseXOR(y))


def _sharing(hashes: DataFrame) -> DataFrame:
    """(p, i): the place i in ``hashes`` of what a row (p, hashes) shares with another row."""
    each = hashes.select("p", F.posexplode("hashes").alias("i", "hash"))
    shared = each.groupBy("hash").agg(F.min("p").alias("one"), F.max("p").alias("two")).where("one <> two")
    return each.join(shared.select("hash"), "hash", "left_semi").select("p", "i")


def _first_places(docs: DataFrame, min_near: int) -> DataFrame:
    """(key, first, n, h0..h3) of the distinct lines: their first place, how often they stand, and their halves' hashes."""
    near = F.length("line") >= min_near
    halves = [F.when(near, _hash_without(F.length("line") - i // 2, F.lit(i % 2), 2)).alias(f"h{i}") for i in range(4)]
    rows = _lines(docs).select(_key().alias("key"), _place().alias("place"), *halves)
    return rows.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n"), *[F.min(f"h{i}").alias(f"h{i}") for i in range(4)])


def _texts(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """(p, line) of these lines p (first, key), from the documents of their first places."""
    document = F.floor(F.col("p.first") / F.lit(1 << 32).cast("decimal(11,0)")).cast("long")
    named = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    lines = _lines(only_keys(named, suspects, _id(F.col("doc_id")), document)).select(_key().alias("key"), "line")
    found = lines.join(suspects.select(F.col("p.key").alias("key"), "p").hint("merge"), "key").select("p", "line")
    return found.dropDuplicates(["p"])


def _variants() -> Column:
    """(hash, at) of the line (at 0), and of the texts that lack the character at a place of the segments ``parts``, where
    an edit may be: part i of length n - i div s is segment i mod s. The hash has 128 bits, as the least of those that share it
    stands for all."""
    n = F.col("n")

    def places(i: Column) -> Column:
        m, j = n - F.floor(i / SEGMENTS).cast("int"), i % SEGMENTS
        return F.sequence(F.floor(m * j / SEGMENTS).cast("int") + 1, F.least(n, F.floor(m * (j + 1) / SEGMENTS).cast("int") + 1))

    at = F.array_distinct(F.flatten(F.transform("parts", places)))
    digest = lambda text: F.unhex(F.md5(text)).alias("hash")
    shorter = F.transform(at, lambda i: F.struct(digest(F.concat(F.substring("line", F.lit(1), i - 1), F.substring("line", i + 1, n))), i.alias("at")))
    return F.concat(F.array(F.struct(digest(F.col("line")), F.lit(0).alias("at"))), shorter)


def near_later(lines: DataFrame) -> DataFrame:
    """(p) of the distinct lines (p, line, parts) that have an earlier partner within one edit."""
    spread = lines.select("p", F.explode(_variants()).alias("v")).select("p", "v.hash", "v.at")
    replaced = F.min("p").over(Window.partitionBy("hash", "at"))
    whole = F.min(F.when(F.col("at") == 0, F.col("p"))).over(Window.partitionBy("hash"))
    lacking = F.min(F.when(F.col("at") > 0, F.col("p"))).over(Window.partitionBy("hash"))
    partners = F.when(F.col("at") == 0, F.array(lacking)).otherwise(F.array(replaced, whole))
    met = spread.select("p", partners.alias("partners")).select("p", F.explode("partners").alias("partner")).where("partner < p").distinct()
    texts = lines.select(F.col("p").alias("partner"), F.col("line").alias("other"))
    return met.join(lines, "p").join(texts, "partner").where(F.levenshtein("line", "other", MAX_EDITS).between(0, MAX_EDITS)).select("p").distinct()


def line_drops(docs: DataFrame, min_near: int = MIN_NEAR_CHARS) -> DataFrame:
    """(d, h, drop): for each document, by id and text hash, the numbers of the lines that go."""
    keys = settle(_first_places(docs, min_near), "lines")
    halves = keys.where("h0 is not null").select(F.struct("first", "key").alias("p"), F.array("h0", "h1", "h2", "h3").alias("hashes"))
    left = settle(_texts(docs, settle(_sharing(halves).select("p").distinct(), "sharing")).withColumn("n", F.length("line")), "texts")
    each = F.concat(*(_hashes_without(F.col("n") - i, SEGMENTS) for i in (0, 1)))
    parts = _sharing(settle(left.select("p", each.alias("hashes")), "hashes")).groupBy("p").agg(F.collect_set("i").alias("parts"))
    near = near_later(settle(left.join(parts, "p"), "suspects")).select(F.col("p.key").alias("near_key"))
    marked = keys.join(near, F.col("key") == F.col("near_key"), "left").where("n > 1 or near_key is not null")
    marked = settle(marked.select("key", "first", "n", F.col("near_key").isNotNull().alias("near")), "marked")
    # lines that are over a thousandth of all, so at most HOT_SHARE of them, are dealt out over SALTS tasks
    hot = marked.join(F.broadcast(keys.agg(F.sum("n").alias("all"))), F.col("n") * HOT_SHARE > F.col("all")).select(F.col("key").alias("hot_key"))
    salts = F.when(F.col("hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = marked.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").select("key", F.explode(salts).alias("salt"), "first", "near")
    salt = F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64("d", "pos"), F.lit(SALTS)).cast("int")).otherwise(0)
    lines = _lines(docs).select(_key().alias("key"), "d", "h", "pos").join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").withColumn("salt", salt)
    gone = lines.join(salted, ["key", "salt"]).where(F.col("near") | (_place() != F.col("first")))
    return gone.groupBy("d", "h").agg(F.collect_set("pos").alias("drop"))


@hidden_pass
def dedup_lines(docs: DataFrame, min_near: int = MIN_NEAR_CHARS) -> DataFrame:
    """``docs`` with the columns it had, ``text`` without the lines that go, and ``n_lines`` and ``n_dropped`` after them.

    Documents that keep all their lines, by the bitmap, stay where they are."""
    drops = settle(line_drops(docs, min_near), "drops")
    text = F.col("text").cast("string")
    named = docs.drop("n_lines", "n_dropped").withColumn("_d", _id(F.col("doc_id"))).withColumn("_h", F.xxhash64(text))
    named = named.withColumn("_n", F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long"))
    some, whole = split_by_keys(named, drops, F.xxhash64("_d", "_h"), F.xxhash64("d", "h"))
    gone = drops.select(F.col("d").alias("_drop_d"), F.col("h").alias("_drop_h"), F.col("drop").alias("_drop"))
    some = some.join(gone, (F.col("_d") == F.col("_drop_d")) & (F.col("_h") == F.col("_drop_h")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.col("_n").cast("int") - 1), "_drop")
    # the text is split once and bound to a name; a split inside the inner function would run for every line
    rest = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))[0]
    some = some.withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(rest))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return some.select(*own, F.col("_n").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped")).unionAll(whole.select(*own, F.col("_n").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))


#: The same for DuckDB, where ids are unique: every pair of distinct lines with lengths at most one apart is compared.
ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT * FROM l WHERE length(translate(line, ' ' || chr(9) || chr(13), '')) > 0),
f AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM t GROUP BY line),
near AS (SELECT DISTINCT a.line FROM f a JOIN f b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first AND a.n >= {MIN_NEAR_CHARS} AND b.n >= {MIN_NEAR_CHARS}
  AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2) OR right(a.line, least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) // 2))
  WHERE levenshtein(a.line, b.line) <= {MAX_EDITS}),
g AS (SELECT t.doc_id, t.pos FROM t JOIN f USING (line) LEFT JOIN near ON near.line = t.line WHERE near.line IS NOT NULL OR (t.doc_id, t.pos) <> f.first),
r AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_dropped
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
