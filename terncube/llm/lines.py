"""Fuzzy line deduplication in DataFrame functions only: character-shingle MinHash, banding, exact Jaccard, union-find.

Lines are compared trimmed and in lower case, as sets of shingles of SHINGLE characters (a shorter line is one shingle).
Equal lines are collapsed first; only distinct ones are signed. A signature is a sorted ring of shingle hashes: each of
BANDS points takes the ROWS hashes that follow it, one permutation serving all bands. Lines of MANY or more words sign with
the shingles at their word starts, the others with all (near the limit with both); sets too small to fill the ring hash
each shingle several times. Lines that agree in a band are candidates, verified on all shingles of both; of each component
of verified links the line that occurs first stays (by document id, text and line number).

A bucket's lines are compared with its leader, the line that most buckets lead to. Lines that the leader does not link are
compared with the others around it by what they differ in from the leader (see _across): no link between lines that share
a leader is lost, and lines that merely share a template are not expanded into pairs.

Defined results: a null text stays null and an empty one empty; lines of white space only stay, all of them; of repeated
rows the first keeps its lines, the others lose them; a null id comes after all others; an empty table gives an empty
result; texts of any length are split whole (a line's shingle hashes, 8 bytes a character, must fit a task). Columns other
than the key, an integer, and the text are passed along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terncube.llm.runtime import Scratch, components, sieve

SHINGLE, BANDS, ROWS = 8, 10, 4
#: From MANY words on a line signs with its word starts. Sets of lo to hi shingles are hashed so many times over. All limits
#: overlap by SLACK: a set near one signs on both sides of it, so that any two lines of similarity 0.8 sign alike at least
#: once.
MANY, SLACK = 24, 1.3
REGIMES = [(1, 2, 64), (2, 4, 32), (4, 8, 16), (8, 16, 8), (16, 32, 4), (32, 64, 2), (64, 1 << 40, 1)]
WORD_STARTS = rf"(?s) (?=(.{{{SHINGLE}}}))"
BLANKS = " \t\n\x0b\f\r"
BLANK_CODES = [ord(c) for c in BLANKS]
#: Rows of one leader that meet in one task.
SALT = 256


def _row(key: str, text: str):
    """A number for a row: its id (null: the largest), then 31 bits of its text's hash, then 31 zero bits for a line number."""
    wide = lambda c, digits=38: c.cast(f"decimal({digits},0)")
    half = F.lit(1 << 31)
    above = wide(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))) + wide(F.lit(1 << 62)) * F.lit(2)
    page = F.pmod(F.xxhash64(text), half)
    return wide(wide(wide(above, 20) * wide(half, 10) + page, 29) * wide(half, 10))


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, line): the compared form of every line that is not blank, place being its row's number plus its number there,
    from 1 on; the order of places is that of ids, texts and lines."""
    parts = docs.select(_row(key, text).alias("row"), F.split(text, "\n", -1).alias("parts"))
    rows = parts.select("row", F.posexplode("parts").alias("at", "raw"))
    edge = F.ascii(F.left("raw", F.lit(1))).isin(BLANK_CODES) | F.ascii(F.right("raw", F.lit(1))).isin(BLANK_CODES)
    form = F.lower(F.when(edge, F.trim("raw", F.lit(BLANKS))).otherwise(F.col("raw")))
    return rows.select((F.col("row") + (F.col("at") + 1)).cast("decimal(38,0)").alias("place"), F.explode(F.array(form)).alias("line")).where("line <> ''")


def _every(line: str) -> str:
    """SQL for the hashes of all shingles of a line given in UTF-16BE. The line is a lambda's variable: a column read in a
    lambda is copied for each shingle, which is quadratic in long lines."""
    one = f"transform(sequence(1, greatest(octet_length(t) - {2 * SHINGLE - 1}, 1), 2), i -> xxhash64(substring(t, i, {2 * SHINGLE})))"
    return f"array_distinct(get(transform(array({line}), t -> {one}), 0))"


def buckets(lines: DataFrame) -> DataFrame:
    """lines, less the line, with an array of BANDS buckets: a row for each way in which the line signs. A point with fewer
    than ROWS hashes before the next one gives a null, no bucket: it would gather lines that share little."""
    rest = [F.col(c) for c in lines.columns if c != "line"]
    starts = F.array_distinct(F.transform(F.regexp_extract_all(F.concat(F.lit(" "), "line"), F.lit(WORD_STARTS), F.lit(1)), lambda s: F.xxhash64(s)))
    blanks = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))  # a line of fewer has not MANY starts
    starts = F.when(blanks >= MANY - 1, starts).otherwise(F.array().cast("array<bigint>"))
    once = F.struct(starts.alias("starts"), F.col("line").alias("text"))  # generated: else each use makes it anew
    out = lines.select(*rest, F.explode(F.array(once)).alias("of"))
    some = F.when(F.size("of.starts") >= MANY, F.struct(F.lit(True).alias("words"), F.col("of.starts").alias("set")))
    every = F.when(F.size("of.starts") < MANY * SLACK, F.struct(F.lit(False).alias("words"), F.expr(_every("encode(of.text, 'UTF-16BE')")).alias("set")))
    out = out.select(*rest, F.explode(F.array(some, every)).alias("as")).where("as is not null").select(*rest, "as.words", "as.set")
    ways = F.array(*[F.when((F.size("set") >= lo) & (F.size("set") < hi * SLACK), F.lit(m)) for lo, hi, m in REGIMES])
    out = out.withColumn("m", F.explode(ways)).where("m is not null")
    again = F.flatten(F.transform(F.sequence(F.lit(1), F.col("m")), lambda j: F.transform("set", lambda h: F.xxhash64(h, j))))
    points = [(1 << 64) // BANDS * i - (1 << 62) * 2 + 1 for i in range(BANDS)]
    out = out.withColumn("set", F.when(F.col("m") == 1, F.col("set")).otherwise(again))
    out = out.withColumn("ring", F.sort_array(F.concat(F.array(*map(F.lit, points)), "set")))
    out = out.select("*", *[F.slice("ring", F.array_position("ring", F.lit(p)).cast("int"), ROWS + 1).alias(f"w{i}") for i, p in enumerate(points)])
    ends = [*points[1:], (1 << 63) - 1]
    keys = [F.when(F.get(f"w{i}", F.lit(ROWS)) < end, F.xxhash64("words", "m", f"w{i}")) for i, end in enumerate(ends)]
    return out.select(*rest, F.array(*keys).alias("buckets"))


def _held(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, bucket, n) for every bucket of n lines, two or more."""
    found = signed.select("id", F.explode("buckets").alias("bucket")).where("bucket is not null")
    return scratch.cut(found.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"))


def _stars(held: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): every line b that shares a bucket with others, and the bucket's leader a: of its lines that with the most
    lines in all its buckets together (of those the first), so that a template's lines all meet the template."""
    met = held.groupBy("id").agg(F.sum("n").alias("met")).join(texts.select("id", "place"), "id")
    first = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("met"), "place"))
    leads = held.join(met, "id").withColumn("k", first).where("k = 1").select("bucket", F.col("id").alias("a"))
    return scratch.cut(held.join(leads, "bucket").where("a <> id").select("a", F.col("id").alias("b")).distinct())


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, n, a_n, d, apart): the distinct pairs with the sizes of the shingle sets of b and a, and the d shingles that
    only one of them has. Rows of one a are dealt over as many tasks as they need."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("shares"))
    side = texts.select("id", F.encode("line", "UTF-16BE").alias("text"))
    ones = side.join(shares, F.col("id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(1), F.col("shares"))).alias("share"), F.col("text").alias("a_text"))
    dealt = pairs.join(shares, "a").select("a", "b", (F.pmod(F.xxhash64("b"), "shares") + 1).cast("int").alias("share"))
    both = dealt.join(side.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b").join(ones, ["a", "share"])
    sets = both.select("a", "b", F.explode(F.array(F.struct(F.expr(_every("a_text")).alias("a"), F.expr(_every("b_text")).alias("b")))).alias("s"))
    sized = sets.select("a", "b", F.size("s.b").alias("n"), F.size("s.a").alias("a_n"), F.concat(F.array_except("s.a", "s.b"), F.array_except("s.b", "s.a")).alias("apart"))
    return sized.select("a", "b", "n", "a_n", F.size("apart").alias("d"), "apart")


def _linked(num: int, den: int):
    """Sets of sizes n and a_n that are apart by d have a similarity of num / den: in whole numbers."""
    return (F.col("n") + F.col("a_n") - F.col("d")) * den >= (F.col("n") + F.col("a_n") + F.col("d")) * num


def _across(stars: DataFrame, comp: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link, both around one leader t but in different components, at least one in another than t.

    Sets o and x link if |o ^ x| <= T = (|o| + |x|) * (den - num) / (den + num). With O = o ^ t and X = x ^ t, both known,
    o ^ x = O ^ X, so at least need = (|O| + |X| - T) / 2 elements are in O and X alike: positive, as o does not link with t.
    In one order of the elements, rare ones around t first, the first shared one is then among the first |O| - need + 1
    of O and as few of X. What is known of any partner bounds need from below, so that each set is indexed by a prefix.

    The elements travel alone, named by one hash of leader and shingle, with the number of their pair; what passes the sieve
    beside the wanted leaders meets none of their elements and ends at the join with the rows."""
    label = lambda c, out: comp.select(F.col("node").alias(c), F.col("component").alias(out))
    placed = stars.drop("apart").join(label("b", "own"), "b", "left").join(label("a", "a_own"), "a", "left")
    placed = placed.select("pair", "a", "b", "n", "a_n", "d", F.coalesce("own", "b").alias("own"), (F.coalesce("own", "b") != F.coalesce("a_own", "a")).alias("out"))
    mixed = placed.groupBy("a").agg(F.max("out").alias("any"), F.count("*").alias("rows")).where("any and rows > 1").select("a")
    rows = scratch.cut(placed.join(mixed, "a"))
    around = sieve(stars.select("pair", "a", "apart"), "a", rows.select("a").distinct())
    items = around.select("pair", "a", F.explode("apart").alias("e")).select("pair", F.xxhash64("a", "e").alias("e"))
    items = items.withColumn("times", F.count("*").over(Window.partitionBy("e")))
    inside = Window.partitionBy("pair")
    shared = items.where("times > 1").withColumns({"k": F.row_number().over(inside.orderBy("times", "e")), "shared": F.count("*").over(inside)})
    c, slack = (den - num) / (den + num), den / num
    most = F.col("n") * (1 + slack) * c
    least = F.greatest(F.col("d") - most, F.when(~F.col("out"), (F.col("n") / slack + F.col("a_n")) * c).otherwise(0.0))
    sized = rows.withColumn("prefix", F.floor((F.col("d") - least + most) / 2 + 1e-6) + 1).drop("a", "a_n")
    posted = shared.join(sized, "pair").withColumn("pos", F.col("d") - F.col("shared") + F.col("k") - 1).where("pos < prefix")
    posted = scratch.cut(posted.select("e", "b", "n", "d", "pos", "own", "out"))
    one = posted.where("out").select("e", *[F.col(x).alias(f"o_{x}") for x in ("b", "n", "d", "pos", "own")])
    near = f"least(n, o_n) * {den} >= greatest(n, o_n) * {num} and 2 * {den + num} * least(d - pos, o_d - o_pos) >= (d + o_d) * {den + num} - (n + o_n) * {den - num}"
    pairs = one.join(posted, "e").where(f"own <> o_own and (not out or o_b < b) and {near}")
    pairs = scratch.cut(pairs.select(F.least("b", "o_b").alias("a"), F.greatest("b", "o_b").alias("b")).distinct())
    scratch.drop(rows, posted)
    return pairs


def repeats(lines: DataFrame, scratch: Scratch, num: int = 8, den: int = 10) -> DataFrame:
    """The places of those distinct lines (id, place, line) that a component of links has beside its first."""
    held = _held(buckets(lines.select("id", "line")), scratch)
    ids = held.select("id").distinct()
    texts = scratch.cut(sieve(lines, "id", ids).join(ids, "id"))  # a semi-join would be moved below the sieve
    stars = _stars(held, texts, scratch)
    scratch.drop(held)
    stars = scratch.cut(_compared(stars, texts).withColumn("pair", F.monotonically_increasing_id()))
    links = scratch.cut(stars.where(_linked(num, den)).select("a", "b"))
    comp = scratch.cut(components(links, scratch))
    across = _across(stars, comp, scratch, num, den)
    scratch.drop(stars)
    more = scratch.cut(_compared(across, texts).where(_linked(num, den)).select("a", "b"))
    joined = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    comp = components(joined, scratch)
    members = scratch.cut(comp.join(texts.select(F.col("id").alias("node"), "place"), "node").select("component", "place"))
    scratch.drop(texts, across)
    first = members.groupBy("component").agg(F.min("place").alias("place")).select("place")
    return scratch.cut(members.select("place").join(first, "place", "left_anti"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 8, den: int = 10) -> DataFrame:
    """docs with the text reduced to the lines that stay; columns and rows are as before."""
    scratch = Scratch(docs.sparkSession)
    lines = split_lines(docs, key, text).groupBy("line").agg(F.min("place").alias("place"))
    lines = scratch.cut(lines.withColumn("id", F.monotonically_increasing_id()))  # a line's short name, once it is written
    gone = repeats(lines, scratch, num, den)
    number = F.col("place") % F.lit(1 << 31).cast("decimal(10,0)")
    left = lines.select("place").join(gone, "place", "left_anti").withColumn("no", number)
    stays = left.groupBy((F.col("place") - F.col("no")).cast("decimal(38,0)").alias("__row")).agg(F.collect_list(F.col("no").cast("int")).alias("__stay"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    k, t = names[key], names[text]
    plain = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("__row", _row(k, t))
    ranked = plain.join(stays, "__row", "left").withColumn("__copy", F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(1))))
    ranked = ranked.withColumn("__parts", F.split(t, "\n", -1))
    blank = F.filter(F.sequence(F.lit(1), F.size("__parts")), lambda i: F.trim(F.element_at("__parts", i), F.lit(BLANKS)) == "")
    own = F.when((F.col("__copy") == 1) & F.col("__stay").isNotNull(), F.col("__stay")).otherwise(F.array().cast("array<int>"))
    kept = F.array_join(F.transform(F.sort_array(F.concat(blank, own)), lambda i: F.element_at("__parts", i)), "\n")
    return ranked.select([(F.when(F.col(t).isNotNull(), kept) if c == text else F.col(n)).alias(c) for c, n in names.items()])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    out = dedup_lines(docs)
    n = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return out.select("doc_id", "n_lines", n.alias("n_kept"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
