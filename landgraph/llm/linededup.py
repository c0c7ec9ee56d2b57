"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct lower-cased words between spaces.  A line goes if an earlier one,
in the order of document id, hash of the text (where an id has several) and line number, has a Jaccard
similarity of at least ``threshold`` with it.  Blank lines stay.

1. The occurrences of all tokens are counted over the whole corpus, by buckets of their hash.  The counts,
   rounded to a quarter of a power of two, are put into one array of bounded size, the order's table.
2. Tokens are ordered by rarity in this table, then by hash.  Of lines with the same set of tokens the
   first is the owner; the others go without being compared.
3. Prefix filter: two lines can only be similar if they share one of the first n - ceil(threshold n) + 1
   tokens of the longer, of n, and of the first m - ceil(2 threshold / (1 + threshold) m) + 1 of the shorter,
   of m.  These postings are joined by token.  Pairs must pass the length filter, the
   positional filter (what can match before and behind the shared token is enough) and the bitmap filter
   (sets of n and m differ in n + m - 2 overlap tokens, and the parities of their tokens' bits in no more places).
4. Tokens that occur more than ``LONG`` times may have long lists.  Their postings are first compared with
   ``LEADERS`` early lines of the list only, each line keeping its most likely match; just the lines that
   this does not show to be later matches are then compared with whole lists, so that a large group of
   near copies never makes all its pairs.
5. The pairs left, few but for true matches, are verified on all tokens.

All of it is DataFrame expressions, in steps that each leave a narrow table; texts move once, to put the
kept lines together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, real_id, stage, told_apart

THRESHOLD, LONG, LEADERS = 0.8, 1024, 24
#: Buckets of the order's table, a byte each, and of the filter of lines to be verified, a bit each.
MAX_RARITY, BUCKETS_A_TEXT, MAX_WANTED = 1 << 24, 8, 1 << 26
#: Sets above this size have two words of parities.
WIDE = 96
_EPS = 1e-9
#: A line: its document's id, the hash that tells texts of one id apart, its number.
_LINE = ("id", "h", "no")


def _power_of_two(n: int, most: int) -> int:
    return min(most, 1 << max(12, (n - 1).bit_length()))


def _dense(rows: DataFrame, size: int, none: Column) -> DataFrame:
    """One row (all): the array of the ``v`` of rows (b, v), b below ``size``, each once; ``none`` where there is no row."""
    zeros = rows.sparkSession.range(size).select(F.col("id").alias("b"))
    filled = zeros.join(rows, "b", "left").select("b", F.coalesce("v", none).alias("v"))
    in_order = lambda key, item: F.transform(F.sort_array(F.collect_list(F.struct(key, item))), lambda r: r[item])
    chunks = filled.groupBy(F.shiftright("b", 12).alias("i")).agg(in_order("b", "v").alias("part"))
    return chunks.agg(F.flatten(in_order("i", "part")).alias("all"))


def _words(line: Column) -> Column:
    """The hashes of a line's words, each once."""
    return F.array_except(F.transform(F.split(F.lower(line), " "), lambda t: F.xxhash64(t)), F.array(F.xxhash64(F.lit(""))))


def _rarity_class(n: Column | int) -> Column:
    return F.least(F.floor(F.log2(F.lit(n) if isinstance(n, int) else n) * 4), F.lit(126)).cast("int") + 1


def rarity_table(texts: DataFrame, column: str = "text") -> tuple[DataFrame, int]:
    """One row (all) and the number of buckets of a token's hash: for each the class of how often its tokens
    occur in all ``texts``.  There are at least as many buckets as ``BUCKETS_A_TEXT`` times the texts, so most hold one or a few tokens."""
    size = _power_of_two(BUCKETS_A_TEXT * texts.count(), MAX_RARITY)
    words = texts.select(F.explode(F.split(F.lower(F.replace(column, F.lit("\n"), F.lit(" "))), " ")).alias("t"))
    counts = words.groupBy(F.xxhash64("t").bitwiseAND(F.lit(size - 1)).alias("b")).count()
    counts = stage(counts.select("b", _rarity_class(F.col("count")).cast("tinyint").alias("v")), "token-counts")
    within, zero = F.col("b").bitwiseAND(F.lit(7)), F.lit(0).cast("tinyint")
    classes = F.array(*(F.coalesce(F.max(F.when(within == k, F.col("v"))), zero) for k in range(8)))
    eight = counts.groupBy(F.shiftright("b", 3).alias("b")).agg(classes.alias("v"))
    table = _dense(eight, size // 8, F.array(*[zero] * 8)).select(F.flatten("all").alias("all"))
    return stage(table, "rarity"), size


def _keys(line: Column, table: Column, size: int) -> Column:
    """The tokens of a line as numbers, sorted: the rarer by ``table`` come first."""

    def key(h: Column) -> Column:
        rarity = F.get(table, h.bitwiseAND(F.lit(size - 1)).cast("int"))
        return F.shiftleft(F.coalesce(rarity, F.lit(0).cast("tinyint")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))  # never null, so sorted as plain numbers

    return F.sort_array(F.transform(_words(line), key))


def _alpha(n: Column, m: Column, threshold: float) -> Column:
    """The least overlap of similar sets of n and m."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - _EPS)


def _lines(texts: DataFrame) -> DataFrame:
    """(id, h, no, line) of the lines that are not blank."""
    return texts.select("id", "h", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.trim("line") != "")


def owners(texts: DataFrame, threshold: float) -> DataFrame:
    """(id, h, no, n, odd, odd_b, prefix, u): the first line of each set of tokens, with the set's size, the
    parities of its tokens' bits (one word of 64, for sets above ``WIDE`` that word and a part of it), its prefix
    and a number of its own, which stands for it in postings and pairs."""
    table, size = rarity_table(texts)
    lines = _lines(texts).withColumn("order", table.scalar())  # Catalyst puts the array into the expression, not into rows
    keyed = lines.select(*_LINE, _keys(F.col("line"), F.col("order"), size).alias("k"))
    shift = lambda on, t: F.call_function("shiftleft", on, t.bitwiseAND(F.lit(63)).cast("int"))
    one = F.lit(1).cast("long")
    parity = F.aggregate("k", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(shift(one, t)))
    part = F.aggregate("k", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(shift(F.shiftrightunsigned(t, 6).bitwiseAND(one), t)))
    n = F.size("k")
    line = F.struct(
        *_LINE,
        n.alias("n"),
        parity.alias("odd"),
        F.when(n > WIDE, part).otherwise(F.lit(0).cast("long")).alias("odd_b"),
        F.slice("k", F.lit(1), (n - F.ceil(n * threshold - _EPS) + 1).cast("int")).alias("prefix"),
    )
    first = keyed.select(F.xxhash64("k").alias("set"), F.hash("k").alias("set_b"), line.alias("r")).groupBy("set", "set_b").agg(F.min("r").alias("r"))
    return stage(first.select("r.*", F.monotonically_increasing_id().alias("u")), "line-owners")


def _earlier() -> Column:
    a_id, b_id, a_h, b_h, a_no, b_no = (F.col(f"{s}{c}") for c in _LINE for s in "ab")
    return (a_id < b_id) | ((a_id == b_id) & ((a_h < b_h) | ((a_h == b_h) & (a_no < b_no))))


def _differ() -> Column:
    """In how many places the parities of a and b differ."""
    odd, part = (F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}")) for c in ("odd", "odd_b"))
    wide = (F.col("an") > WIDE) & (F.col("bn") > WIDE)
    return F.when(wide, F.bit_count(odd.bitwiseXOR(part)) + F.bit_count(part)).otherwise(F.bit_count(odd))


def _may_match(threshold: float) -> Column:
    """The three filters, for rows of a and b that share a token."""
    an, bn, ap, bp = (F.col(c) for c in ("an", "bn", "apos", "bpos"))
    least = (an + bn) * (threshold / (1 + threshold)) - _EPS  # not rounded up, which is the same for whole numbers of tokens
    length = F.least(an, bn) >= F.greatest(an, bn) * threshold - _EPS
    behind = F.least(ap, bp) + F.least(an - ap, bn - bp)  # at most so many tokens match before, and from here on
    return length & (behind >= least) & (_differ() <= an + bn - 2 * _alpha(an, bn, threshold))


def _is_long(t: Column) -> Column:
    """Whether the token, a key of ``_keys``, may have a long list."""
    return t >= F.shiftleft(_rarity_class(LONG + 1).cast("long"), 56)


def _short_postings(lines: DataFrame, side: str) -> DataFrame:
    """The postings of the tokens of prefixes that have short lists; columns but the token are named after ``side``.
    The set's size and the token's place share a number (see ``_unpacked``), as there are very many of these rows."""
    places = lines.select("u", "n", "odd", "odd_b", F.posexplode("prefix").alias("pos", "t")).where(~_is_long(F.col("t")))
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    return places.select("t", packed.alias(f"{side}at"), *(F.col(c).alias(f"{side}{c}") for c in ("u", "odd", "odd_b")))


def _unpacked(pairs: DataFrame) -> DataFrame:
    n, pos = (lambda s: F.shiftright(f"{s}at", 32).alias(f"{s}n")), (lambda s: F.col(f"{s}at").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"{s}pos"))
    return pairs.select("*", *(f(s) for f in (n, pos) for s in "ab"))


def _long_postings(lines: DataFrame) -> DataFrame:
    """The postings of the other tokens: a line, ``pos``, ``t``, and all such tokens of its prefix, ``long``."""
    some = lines.where(_is_long(F.element_at("prefix", -1)))  # a prefix is sorted by rarity, so these tokens are its end
    columns = ("u", *_LINE, "n", "odd", "odd_b", "long")
    rows = some.withColumn("long", F.filter("prefix", _is_long)).select(*columns, F.size("prefix").alias("p"), F.posexplode("long").alias("pos", "t"))
    return stage(rows.select(*columns, (F.col("p") - F.size("long") + F.col("pos")).alias("pos"), "t"), "long-postings")


def _side(postings: DataFrame, side: str) -> DataFrame:
    return postings.select(*(F.col(c) if c == "t" else F.col(c).alias(f"{side}{c}") for c in postings.columns))


def _likely(long: DataFrame, threshold: float) -> DataFrame:
    """For lines in long lists, the pair with that leader that differs least, of the lists of the rarest and
    of the commonest of their long tokens.

    The leaders of a list are the first lines of ``LEADERS`` random parts of it.
    """
    dealt = long.withColumn("part", F.pmod(F.xxhash64("t", *_LINE), F.lit(LEADERS)).cast("int"))
    leaders = dealt.groupBy("t", "part").agg(F.min(F.struct(*_LINE, "u", "n", "odd", "odd_b", "pos")).alias("r")).select("t", "r.*")
    own = long.where((F.col("t") == F.element_at("long", 1)) | (F.col("t") == F.element_at("long", -1)))
    pairs = _side(leaders, "a").join(_side(own.drop("long"), "b"), "t").where(_earlier() & _may_match(threshold))
    slack = _differ() - (F.col("an") + F.col("bn") - 2 * _alpha(F.col("an"), F.col("bn"), threshold))
    best = pairs.groupBy("bu").agg(F.min(F.struct(slack, *(f"a{c}" for c in _LINE), "au")).alias("r"))
    return best.select("r.au", "bu")


def _in_short_lists(lines: DataFrame, threshold: float) -> DataFrame:
    """All pairs that share a token of short lists and pass the filters, each by the shorter line's part of its prefix."""
    first = (F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - _EPS) + 1).cast("int")
    shorter = _short_postings(lines.withColumn("prefix", F.slice("prefix", F.lit(1), first)), "a")
    pairs = _unpacked(shorter.join(_short_postings(lines, "b"), "t"))
    pairs = pairs.where((F.col("an") <= F.col("bn")) & _may_match(threshold) & (F.col("au") != F.col("bu")))
    return pairs.select(F.least("au", "bu").alias("au"), F.greatest("au", "bu").alias("bu")).distinct()


def _in_long_lists(long: DataFrame, done: DataFrame, threshold: float) -> DataFrame:
    """All pairs of lines in long lists and later ones, not yet ``done``, that pass the filters, by their first common token."""
    later = long.join(done, "u", "left_anti")
    once = F.element_at(F.array_intersect("along", "blong"), 1) == F.col("t")
    return _side(long, "a").join(_side(later, "b"), "t").where(_earlier() & _may_match(threshold) & once).select("au", "bu")


def _among(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """A condition that holds for all whose ``columns`` are among the ``rows``, and for few others: a bit of a hash each."""
    size = _power_of_two(16 * rows.count(), MAX_WANTED)
    place = F.xxhash64(*columns).bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = rows.groupBy(F.shiftright(place, 6).alias("b")).agg(F.bit_or(bit).alias("v"))
    bits = stage(_dense(words, size // 64, F.lit(0).cast("long")), "wanted").scalar()
    return F.coalesce(F.get(bits, F.shiftright(place, 6).cast("int")).bitwiseAND(bit), F.lit(0).cast("long")) != 0


def _verified(pairs: DataFrame, lines: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(u) of the later lines of those pairs that are similar.

    The tokens of all lines of pairs are taken from the texts once more; filters of hashes of their
    documents and of themselves spare the others the join.
    """
    pairs = stage(pairs, "line-pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("bu").alias("u"))
    ends = lines.select("u", *_LINE).join(pairs.select(F.explode(F.array("au", "bu")).alias("u")).distinct(), "u", "left_semi")
    ends = stage(ends, "pair-ends")
    in_docs, in_lines = _among(ends, ("id", "h")), _among(ends, _LINE)
    sets = _lines(texts.where(in_docs)).where(in_lines).join(ends, [*_LINE]).select("u", *_LINE, _words(F.col("line")).alias("k"))
    sets = stage(sets.dropDuplicates([*_LINE]), "line-sets")
    for s in "ab":
        pairs = pairs.join(_side(sets, s), f"{s}u")
    same = F.size(F.array_intersect("ak", "bk"))
    found = pairs.where(same >= (F.size("ak") + F.size("bk") - same) * threshold - _EPS)
    return stage(found.select(F.when(_earlier(), F.col("bu")).otherwise(F.col("au")).alias("u")).distinct(), "later-lines")


def _numbers_by_document(lines: DataFrame) -> DataFrame:
    """(id, h, kept): the sorted numbers of the lines (id, h, no), each once.  They are first put together as the bits
    of words of 64, one number that a hash aggregate updates in place, so that hardly more than a row a document is collected."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("no").bitwiseAND(F.lit(63)))
    words = lines.repartition("id", "h").groupBy("id", "h", F.shiftright("no", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    words = words.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words"))
    there = lambda r: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(r["bits"], i) == 1)
    numbers = F.transform("words", lambda r: F.transform(there(r), lambda i: r["at"] * 64 + i))
    return words.select("id", "h", F.flatten(numbers).alias("kept"))


def similar_lines(texts: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(u) of the owners that an earlier owner is similar to."""
    long = _long_postings(lines)
    likely = stage(_likely(long, threshold), "line-pairs")
    done = _verified(_in_short_lists(lines, threshold).unionByName(likely).distinct(), lines, texts, threshold)
    return done.unionByName(_verified(_in_long_lists(long, done, threshold), lines, texts, threshold))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove later matches among all lines of all documents.

    Returns ``id_column``, ``n_lines``, ``kept`` (numbers of the kept lines that are not blank,
    from 0) and ``text`` without the removed lines, for every row, and its columns ``carry``.  Rows
    that repeat an id and its text are one document, rows of one id (or none) with other texts are
    others.  A null id is below all others.  A null text has no lines and stays null; a document
    may end up empty, and stays.
    """
    need(docs, id_column, text_column, *carry)
    rest = F.struct(F.lit(0), *carry).alias("rest")
    rows = told_apart(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), rest))
    texts = rows.select("id", "h", "text")
    lines = owners(texts, threshold)
    kept = lines.select("u", *_LINE).join(similar_lines(texts, lines, threshold), "u", "left_anti")
    whole = rows.join(_numbers_by_document(kept).hint("shuffle_hash"), ["id", "h"], "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    whole = whole.withColumn("lines", F.split("text", "\n"))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    stay = F.transform(F.sort_array(F.concat("kept", blank)), lambda i: F.get("lines", i))
    return whole.select(
        real_id().cast(docs.schema[id_column].dataType).alias(id_column),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        "kept",
        F.when(F.col("text").isNotNull(), F.array_join(stay, "\n")).alias("text"),
        *(F.col("rest").getField(c).alias(c) for c in carry),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without lines that are similar to an earlier one."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
