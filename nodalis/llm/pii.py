"""Personal data by patterns and bootstrapped contextual extraction, in
DataFrame functions only.

Base entities (email, ip, card, phone) come from regular expressions with
positions in code points: splitting a text at a pattern gives the gaps between
its matches, so positions are running sums of lengths (in chunks, so that a text
of n matches costs about n^1.5 copies of a number, not n^2).

Contextual extraction finds identifiers that no pattern describes.  Every base
span is an instance, a seed, and so is every token that overlaps none and is no
plain word (it holds a digit, ``@`` or ``_``; TOKEN_CHARS at least without outer
punctuation).  Each stands in three lexical patterns: the word before, the two
words before, and the words on both sides (a word after says too little alone).
Words are those within CONTEXT_CHARS, of any kind, lower-cased, digits as 0,
without what is glued to a span; a text's begin and end count as an empty word.

Bootstrapping, ROUNDS times: a pattern's confidence is the mean of its distinct
instances'; it is sure at LEAST or more with SUPPORT instances of LEAST or more,
seeds or found.  A seed's confidence is 1, another instance's the noisy-or over
its sure patterns, 0 at first: what a round finds makes new patterns sure in the
next.  Tokens in sure patterns are spans of kind ``id``.  Names written as plain
words are never found: each word would be an instance.

Scale: one scan makes a slim table of spans and instances (checkpointed in the
shared folder); the graph's edges are distinct (pattern, instance) hashes, every
step is an aggregation with partial sums or a join whose hot keys are salted;
texts are never shuffled.

Null text counts as empty.  Rows with the same doc_id and text, or a null
doc_id, keep a row each with the same spans.  An empty table gives an empty one.
Counts are 0 and lists empty strings where nothing is found.  Other columns may
have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import cut, if_small, salted_join, table

#: Kinds in the order that ties in the lists take.
KINDS = ("email", "ip", "card", "phone")
# Java forms of the patterns that take linear time.  A match begins where a run
# begins or the last match ended, since starting later in a run ends the same way.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
# whole runs of 14 to 19 digits; longer and shorter runs can't pass and end where they end
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@_]*+[0-9@_]\S*+"

ROUNDS = 3
SUPPORT = 3
LEAST = 0.8
#: Shortest token that can be an identifier, and characters of context read on each side.
TOKEN_CHARS = 6
CONTEXT_CHARS = 64


NONE = "cast(array() as array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>)"
LONGS = "cast(array() as array<bigint>)"
#: Spaces, and a word's share glued to a span's start or end.
BLANK, GLUED = r"\s+", (r"\S++$", r"^\S++")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(longs: str, step: str, start: str) -> str:
    """SQL for the running values of ``step`` (a format of u and v) over
    array<bigint> ``longs``, by chunks of about the square root of its size."""
    return f"""
    transform(transform(array({longs}), x_ -> named_struct('x', x_, 'w', greatest(16, cast(sqrt(size(x_)) as int)))), y_ -> if(size(y_.x) = 0, {LONGS}, transform(array(
      transform(sequence(0, cast((size(y_.x) - 1) div y_.w as int)), c_ -> aggregate(slice(y_.x, c_ * y_.w + 1, y_.w),
        named_struct('t', cast({start} as bigint), 'o', {LONGS}),
        (a_, n_) -> named_struct('t', {step.format(u="a_.t", v="n_")}, 'o', array_append(a_.o, {step.format(u="a_.t", v="n_")})), a_ -> a_.o))), p_ ->
      flatten(zip_with(p_, aggregate(p_, named_struct('t', cast({start} as bigint), 'o', {LONGS}),
        (a_, n_) -> named_struct('t', {step.format(u="a_.t", v="element_at(n_, -1)")}, 'o', array_append(a_.o, a_.t)), a_ -> a_.o),
        (b_, h_) -> transform(b_, n_ -> {step.format(u="h_", v="n_")}))))[0]))[0]"""


SUM, MOST, FEWEST = "{u} + {v}", "greatest({u}, {v})", "least({u}, {v})"


def _matches(text: str, pattern: str) -> str:
    """SQL for array<struct<s,e,m,l,r>>: start, end, match, and CONTEXT_CHARS
    before and after of each match.  Gap i stands before match i."""
    p, c = _quoted(pattern), CONTEXT_CHARS
    before = ", ".join(f"coalesce(right(get({x}, {i}), {c}), '')" for x, i in (("z.m", "i - 2"), ("z.g", "i - 1"), ("z.m", "i - 1"), ("z.g", "i")))
    after = ", ".join(f"coalesce(left(get({x}, {i}), {c}), '')" for x, i in (("z.g", "i + 1"), ("z.m", "i + 1"), ("z.g", "i + 2")))
    return f"""
    transform(transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))),
      q -> named_struct('m', q.m, 'g', q.g, 'e', {_running("transform(q.m, (x, i) -> cast(length(get(q.g, i)) + length(x) as bigint))", SUM, "0")})), z ->
      transform(z.m, (x, i) -> named_struct('s', get(z.e, i) - length(x), 'e', get(z.e, i), 'm', x,
        'l', right(concat({before}), {c}), 'r', left(concat({after}), {c}))))[0]"""


def _context(x: str) -> str:
    """SQL for the fields l and r of struct ``x``: the last two words before, the
    last first, and the word after ('' for none)."""
    blank, before, after = _quoted(BLANK), *map(_quoted, GLUED)

    def word(s: str) -> str:
        return f"filter(split(translate(lower({s}), '123456789', '000000000'), {blank}), w -> w <> '')"

    return f"""'l', transform(array(reverse({word(f"regexp_replace({x}.l, {before}, '')")})), w -> array(coalesce(get(w, 0), ''), coalesce(get(w, 1), '')))[0],
      'r', coalesce(get({word(f"regexp_replace({x}.r, {after}, '')")}, 0), '')"""


LUHN = """(
  aggregate(
    transform(split(reverse(regexp_replace(x.m, '[ -]', '')), ''), (d, i) -> if(i % 2 = 0, cast(d as int), if(cast(d as int) > 4, 2 * cast(d as int) - 9, 2 * cast(d as int)))),
    0, (a, v) -> a + coalesce(v, 0)) % 10 = 0)"""


def base_spans(text: str = "_t") -> dict[str, Column]:
    """Array columns of each kind's spans (s, e, m, l, r)."""
    keep = {
        "email": (f"instr({text}, '@') > 0", EMAIL, "true"),
        "ip": (f"instr({text}, '.') > 0", IP, "forall(split(x.m, '\\\\.'), p -> cast(p as double) <= 255)"),
        "card": ("true", CARD, LUHN),
        "phone": (f"instr({text}, '+') > 0", PHONE, "length(regexp_replace(x.m, '[^0-9]', '')) between 10 and 15"),
    }
    return {k: F.expr(f"case when {cond} then filter({_matches(text, pat)}, x -> {test}) else {NONE} end") for k, (cond, pat, test) in keep.items()}


def instances(text: str = "_t") -> Column:
    """Array of struct(s, m, l, r): tokens that are no plain words, their place,
    and the words before and after."""
    trim = _quoted(r"^[^\p{L}\p{N}]+"), _quoted(r"[^\p{L}\p{N}]+$")
    return F.expr(f"""
    filter(
      transform({_matches(text, TOKEN)},
        x -> named_struct(
          's', x.s + length(x.m) - length(regexp_replace(x.m, {trim[0]}, '')),
          'm', regexp_replace(regexp_replace(x.m, {trim[0]}, ''), {trim[1]}, ''),
          {_context("x")})),
      x -> length(x.m) >= {TOKEN_CHARS})""")


def free_tokens(base: str = "base", tokens: str = "tokens") -> Column:
    """The tokens that overlap no base span: both lists in one order, the furthest
    end of a span so far and the first start of one to come."""
    far = 1 << 62
    both = f"""array_sort(concat(
        transform({base}, x -> named_struct('s', x.s, 'o', 0, 'e', x.e, 'i', -1)),
        transform({tokens}, (x, i) -> named_struct('s', x.s, 'o', 1, 'e', x.s + length(x.m), 'i', i))))"""
    ends = _running("transform(k, x -> if(x.o = 0, x.e, 0L))", MOST, "0")
    starts = _running(f"transform(reverse(k), x -> if(x.o = 0, x.s, {far}L))", FEWEST, f"{far}L")
    return F.expr(f"""if(size({base}) = 0 or size({tokens}) = 0, {tokens},
      transform(transform(array({both}), k -> named_struct('k', k, 'a', {ends}, 'b', reverse({starts}))), z ->
        transform(filter(transform(z.k, (x, j) -> if(x.o = 1 and get(z.a, j) <= x.s and get(z.b, j) >= x.e, x.i, -1)), i -> i >= 0), i -> get({tokens}, i)))[0])""")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k, h, base, seeds, tokens): the slim table; one row for each of ``df``."""
    src = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    found = src.select("_k", F.xxhash64("_t").alias("h"), *[c.alias(k) for k, c in base_spans().items()], instances().alias("tokens"))
    tagged = F.concat(*[F.expr(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))") for i, k in enumerate(KINDS)])
    seeds = F.expr(f"transform(concat({', '.join(KINDS)}), x -> named_struct('m', x.m, {_context('x')}))")
    found = found.select("_k", "h", F.array_sort(tagged).alias("base"), seeds.alias("seeds"), "tokens")
    return found.withColumn("tokens", free_tokens())


def _patterns(x: str):
    """The three patterns of an instance, as hashes."""
    one, two, after = F.element_at(f"{x}.l", 1), F.element_at(f"{x}.l", 2), F.col(f"{x}.r")
    kinds = {"before": (one,), "two": (one, two), "around": (one, after)}
    return F.explode(F.array(*[F.xxhash64(F.lit(k), *words) for k, words in kinds.items()])).alias("p")


def _edges(slim: DataFrame) -> DataFrame:
    """One row for each instance and pattern: (_k, h, p, v, s, e, seed); base
    spans, whose s and e are null, are the seeds."""
    t = slim.select("_k", "h", F.explode("tokens").alias("t"))
    t = t.select("_k", "h", F.col("t.s").alias("s"), (F.col("t.s") + F.length("t.m")).alias("e"), F.xxhash64("t.m").alias("v"), F.lit(False).alias("seed"), _patterns("t"))
    b = slim.select("_k", "h", F.explode("seeds").alias("b"))
    none = F.lit(None).cast("bigint")
    return t.unionByName(b.select("_k", "h", none.alias("s"), none.alias("e"), F.xxhash64("b.m").alias("v"), F.lit(True).alias("seed"), _patterns("b")))


def learn_patterns(edges: DataFrame) -> DataFrame:
    """(p): hashes of the sure patterns.  ``edges`` has p, v and seed."""
    pairs = edges.groupBy("p", "v").agg(F.max(F.col("seed").cast("int")).alias("seed"))
    # a pattern of fewer instances can never have the support, in any round
    enough = pairs.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("p")
    pairs = cut(salted_join(cut(pairs), enough, "p"))
    conf = cut(pairs.groupBy("v").agg(F.max("seed").cast("double").alias("c")))
    out = None
    for step in range(ROUNDS):
        sure = F.sum((F.col("c") >= LEAST).cast("int"))
        out = salted_join(pairs, conf, "v").groupBy("p").agg(F.avg("c").alias("c"), sure.alias("n")).where((F.col("c") >= LEAST) & (F.col("n") >= SUPPORT)).select("p", "c")
        out = cut(out)
        if step + 1 < ROUNDS:
            lift = salted_join(pairs, out.withColumnRenamed("c", "w"), "p", "left")
            miss = F.sum(F.log(1 - F.least(F.coalesce("w", F.lit(0.0)), F.lit(1 - 1e-9))))
            conf = cut(lift.groupBy("v").agg(F.max("seed").alias("seed"), (1 - F.exp(miss)).alias("n")).select("v", F.greatest(F.col("seed").cast("double"), "n").alias("c")))
    return out.select("p")


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, base, spans) for each row: arrays of struct(s, k, e) with the
    kind's number (len(KINDS) for ``id``), by start and kind."""
    slim = cut(scan(df, key, text))
    edges = _edges(slim)
    good = if_small(learn_patterns(edges))
    more = edges.where(~F.col("seed")).join(good, "p", "left_semi").groupBy("_k", "h").agg(F.collect_set(F.struct("s", F.lit(len(KINDS)).alias("k"), "e")).alias("more"))
    out = slim.alias("a").join(more.alias("b"), F.col("a._k").eqNullSafe(F.col("b._k")) & (F.col("a.h") == F.col("b.h")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<s:bigint,k:int,e:bigint>>)"))))
    return out.select(F.col("a._k").alias(key), F.col("a.h").alias("h"), "base", spans.alias("spans"))


def _list(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, "id")) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with each span of its text replaced by its kind in brackets; of
    overlapping spans the first has its name.  Null texts stay null; rows and
    columns stay as they are.  Offsets are taken in UTF-32, where a slice costs
    its own length only."""
    found = find(df, key, text).where("size(spans) > 0").select(F.col(key).alias("k"), "h", "spans").dropDuplicates(["k", "h"]).select(F.struct("k", "h", "spans").alias("f"))
    found = if_small(found, F.size("f.spans") + 1)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in (*KINDS, "id")) + ")"
    ends = _running("transform(f.spans, x -> x.e)", MOST, "0")
    masked = F.expr(f"""
      transform(array(named_struct('t', encode(t, 'UTF-32'), 'x', f.spans, 'e', {ends})), z -> concat(
        array_join(filter(transform(z.x, (x, i) -> transform(array(coalesce(get(z.e, i - 1), 0L)), a ->
          if(x.s >= a, concat(decode(substring(z.t, cast(4 * a + 1 as int), cast(4 * (x.s - a) as int)), 'UTF-32'), {names}[x.k]), null))[0]), w -> w is not null), ''),
        decode(substring(z.t, cast(4 * element_at(z.e, -1) + 1 as int)), 'UTF-32')))[0]""")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).withColumn("t", F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")))
    joined = rows.join(found, F.col("row").getField(key).eqNullSafe(F.col("f.k")) & (F.xxhash64("t") == F.col("f.h")), "left")
    return joined.select(*[(F.when(F.col("f").isNull(), F.col("row").getField(c)).otherwise(masked) if c == text else F.col("row").getField(c)).alias(c) for c in df.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_list("base").cast("binary"), 256).alias("base_sha256"), _list("spans").alias("spans"))
