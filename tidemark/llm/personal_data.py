"""Personal data: four fixed kinds, and identifiers that bootstrapped contexts discover; DataFrame functions only.

Base kinds, leftmost and non-overlapping per kind: ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits passing
Luhn) and ``phone`` (8 to 15 digits); failing matches are dropped and not tried again.

``context`` adds to them, by bootstrapping:

1. *Tokens* are the base kinds' shapes and other strings that may identify somebody: ``SHORTEST`` to 81 characters from
   letters, digits and ``@._%+/-`` with a digit or an @. Tokens of a base kind are the seeds.
2. Every token induces two lexical patterns: the word before it, and the two words before it (lower case).
3. Patterns and distinct instances (tokens) form a graph, pre-aggregated to one edge a pair. A seed's trust is 1. In each of
   ``ROUNDS`` rounds a pattern's score is the mean trust of its distinct instances if these hold ``SUPPORT`` of trust, else 0.
   A pattern with a score of ``CONFIDENT`` must also be specific: of all places of its words in the corpus, ``SPECIFIC`` must
   stand before a token, so that function words never become patterns. An instance's trust is 1 - the product of
   (1 - score) over its confident patterns, damped by ``DAMPING``. So patterns learned from seeds discover identifiers, and
   those teach further patterns.
4. A token that is no seed, has ``LEAST_DIGITS`` digits and stands in a confident pattern is reported if no base span meets it.

Texts are read once for base spans and tokens, which are written to the shared checkpoint folder, and once more in a round
that has new patterns to judge. Edges, scores and trusts are grouped with partial sums. Scores are looked up by joins on
(pattern, salt): a pattern that holds a third of all edges is dealt to ``SALTS`` tasks, and confident patterns are a small
share of all. Patterns to judge are broadcast if there are at most ``BROADCAST_PATTERNS``, else joined.

A restart inside a run can't match where its first character failed, so expressions start at a run's first character (or
where the last match ended), and a very long run is read once. Null texts are empty, repeated rows stay repeated, an empty
table gives an empty result, only id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import keep_plan_short

KINDS = ("email", "ip", "card", "phone")
#: Possessive where nothing that follows could match what is given back.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SHORTEST, LEAST_DIGITS = 5, 3
#: Before a token none of its characters may stand; then a base kind's shape, or a mixed string.
TOKEN = (
    r"(?<![A-Za-z0-9@._%+/-])(?:\+[0-9][\x20().0-9-]{5,30}[0-9]|[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
    r"|(?:[A-Za-z@._%+/-]{0,40}[0-9]|[A-Za-z._%+-]{1,40}@)[A-Za-z0-9@._%+/-]{2,60}[A-Za-z0-9])(?![A-Za-z0-9@_%+/-])"
)
BEFORE = r"(?:([\p{L}]{1,24})[^\p{L}\p{N}]{1,3})?([\p{L}]{1,24})[^\p{L}\p{N}]{0,3}$"
#: Characters before a token that patterns may take.
AROUND = 56
ROUNDS, SUPPORT, CONFIDENT, SPECIFIC, DAMPING = 3, 4.0, 0.6, 0.1, 0.9
SALTS, BROADCAST_PATTERNS = 32, 500_000


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' sum, every second one from the right doubled (less 9 above 9), is a multiple of ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = d * 2
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """Whether a match of the kind's expression passes its check."""
    digits = _digits(text)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(small, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


#: Spans whose lengths are summed in one fold; blocks of them are then shifted.
FOLD = 256


def with_matches(df: DataFrame, patterns: dict[str, str], needs: dict[str, str]) -> DataFrame:
    """A column for each pattern, array<struct<m, gap, n, left>>: the match, the length of the text between the last one and it,
    its own length, and what stands before it up to the last one, ``AROUND`` characters at most.

    Texts without a sign that a pattern ``needs`` are not searched. Matches and what is between them are columns of their
    own, because higher-order functions would evaluate them at every mention.
    """

    def searched(name: str, found: Column) -> Column:
        return F.when(F.contains("text", F.lit(needs[name])), found) if name in needs else found

    def joined(name: str) -> Column:
        found, between = f"found_{name}", f"between_{name}"
        return F.zip_with(
            found,
            F.slice(between, 1, F.size(found)),
            lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.length(m).alias("n"), F.right(g, F.lit(AROUND)).alias("left")),
        )

    found = df.withColumns({f"found_{k}": searched(k, F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, p in patterns.items()})
    split = found.withColumns({f"between_{k}": F.when(F.size(f"found_{k}") > 0, F.split("text", p, -1)) for k, p in patterns.items()})
    return split.withColumns({k: F.when(F.size(f"found_{k}") > 0, joined(k)) for k in patterns}).drop(*(f"{x}_{k}" for x in ("found", "between") for k in patterns))


_LOCAL = (
    "aggregate({block}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,m:string,left:string>>)), (s, p) -> named_struct('at', s.at + p.gap + p.n,"
    " 'out', array_append(s.out, named_struct('start', s.at + p.gap, 'end', s.at + p.gap + p.n, 'm', p.m, 'left', p.left))))"
)


def placed(pairs: str) -> Column:
    """Matches (a column's name) with places, by sums of the lengths before: array<struct<start, end, m, left>>.

    Folds append to what they hold, so they run over blocks, and a second one over the blocks' lengths: a text of a million
    matches is not copied a million times.
    """
    blocks = f"transform(sequence(0, cast((size({pairs}) - 1) div {FOLD} as int)), b -> {_LOCAL.format(block=f'slice({pairs}, b * {FOLD} + 1, {FOLD})')})"
    shifts = "aggregate(blocks, named_struct('at', 0, 'out', cast(array() as array<int>)), (s, b) -> named_struct('at', s.at + b.at, 'out', array_append(s.out, s.at))).out"
    shifted = "transform(b.out, p -> named_struct('start', p.start + d, 'end', p.end + d, 'm', p.m, 'left', p.left))"
    # A one-element array binds the blocks to a name, so that they are made once.
    whole = f"flatten(flatten(transform(array({blocks}), blocks -> zip_with(blocks, {shifts}, (b, d) -> {shifted}))))"
    return F.expr(f"if(size({pairs}) > 0, {whole}, cast(array() as array<struct<start:int,end:int,m:string,left:string>>))")


def _spans(kind: str, spans: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def is_seed(token: Column) -> Column:
    """Whether a token as a whole is a base kind's match that passes its check."""
    return reduce(lambda a, b: a | b, [token.rlike(f"^(?:{EXPRESSIONS[k]})$") & valid(k, token) for k in KINDS])


def patterns_of(left: Column) -> Column:
    """The lexical patterns before a token: one word, and two words if two stand there."""
    first, last = F.lower(F.regexp_extract(left, BEFORE, 1)), F.lower(F.regexp_extract(left, BEFORE, 2))
    return F.array_compact(F.array(F.when(last != "", last), F.when(first != "", F.concat_ws(" ", first, last))))


def places_of(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, places: how often each pattern's words stand in the texts, whatever follows them."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    split = docs.select(words.alias("words"))
    pairs = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.concat_ws(" ", a, b))  # the last one has no second word
    every = split.select(F.explode(F.concat("words", F.slice(pairs, 1, F.size("words") - 1))).alias("pattern"))
    known = F.broadcast(patterns) if patterns.count() <= BROADCAST_PATTERNS else patterns
    return every.join(known, "pattern").groupBy("pattern").agg(F.count("*").alias("places"))


def facts_of(docs: DataFrame) -> DataFrame:
    """One row a document: rid, doc_id, spans of the base kinds and tokens with their patterns; written once."""
    text = F.coalesce("text", F.lit(""))
    needs = {"email": "@", "ip": ".", "phone": "+"}
    df = with_matches(docs.select(F.col("doc_id").cast("long"), text.alias("text")), EXPRESSIONS | {"tokens": TOKEN}, needs)
    df = df.drop("text").withColumns({k: placed(k) for k in (*KINDS, "tokens")})
    good = lambda kind: F.filter(kind, lambda s: valid(kind, s["m"]))
    base = {k: F.transform(good(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS}
    some = F.filter("tokens", lambda t: F.length(t["m"]) >= SHORTEST)
    tokens = F.transform(
        some,
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), is_seed(t["m"]).alias("seed"), (F.length(_digits(t["m"])) >= LEAST_DIGITS).alias("fit"),
            F.lower(F.regexp_replace(t["m"], "[^A-Za-z0-9@]", "")).alias("instance"), patterns_of(t["left"]).alias("patterns"),
        ),
    )
    known = F.filter(tokens, lambda t: F.size(t["patterns"]) > 0)
    return keep_plan_short(df.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *(base[k].alias(k) for k in KINDS), known.alias("tokens")))


def _looked_up(rows: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join on ``key``; rows of one key are dealt to SALTS tasks by ``spread``, the other side is repeated for each."""
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS).cast("long"))).join(salted, [key, "salt"]).drop("salt")


def confident_patterns(docs: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``edges`` (pattern, instance, seed, uses; distinct pairs) to the confident and specific patterns after all rounds."""
    sums = F.count("*").alias("n"), F.sum(F.col("seed").cast("double")).alias("seeds"), F.sum("uses").alias("uses")
    totals = keep_plan_short(edges.groupBy("pattern").agg(*sums).where(F.col("n") >= SUPPORT))
    unseen = edges.where("not seed").select("pattern", "instance")
    learned = None
    judged = confident = totals.limit(0).select("pattern", F.lit(True).alias("specific"))
    for _ in range(rounds):
        told = totals.withColumn("trust", F.col("seeds"))
        if learned is not None:
            told = totals.join(learned, "pattern", "left").withColumn("trust", F.col("seeds") + F.coalesce("learned", F.lit(0.0)))
        likely = keep_plan_short(told.where(F.col("trust") >= SUPPORT - 1e-9).select("pattern", "uses", (F.col("trust") / F.col("n")).alias("score")).where(F.col("score") >= CONFIDENT))
        new = likely.join(judged, "pattern", "left_anti").select("pattern", "uses")
        places = places_of(docs, new.select("pattern"))
        fresh = new.join(places, "pattern").select("pattern", (F.col("uses") >= SPECIFIC * F.col("places")).alias("specific"))
        judged = keep_plan_short(judged.unionByName(fresh))
        confident = likely.join(judged.where("specific"), "pattern").select("pattern", "score")
        if confident.isEmpty():
            break
        doubt = F.sum(F.log(1 - DAMPING * F.col("score")))
        trust = _looked_up(unseen, confident, "pattern", "instance").groupBy("instance").agg((1 - F.exp(doubt)).alias("trust"))
        learned = _looked_up(unseen, trust, "instance", "pattern").groupBy("pattern").agg(F.sum("trust").alias("learned"))
    return confident.select("pattern")


def context_spans(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """rid, start and end of the tokens that confident patterns discover and no base span meets."""
    token = facts.select("rid", F.explode("tokens").alias("t")).select("rid", "t.start", "t.end", "t.seed", "t.fit", "t.instance", F.explode("t.patterns").alias("pattern"))
    edges = keep_plan_short(token.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("uses")))
    confident = confident_patterns(docs, edges)
    hits = _looked_up(token.where("fit and not seed"), confident, "pattern", "rid").select("rid", "start", "end").distinct()
    every = F.flatten(F.array(*(F.col(k) for k in KINDS)))
    base = facts.join(hits.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode(every).alias("s")).select("rid", "s.start", "s.end", F.lit(True).alias("base"))
    both = hits.withColumn("base", F.lit(False)).unionByName(base)
    up = "max(if(base, end, null)) over (partition by rid order by start, base desc rows between unbounded preceding and current row)"
    down = "min(if(base, start, null)) over (partition by rid order by start desc, base desc rows between unbounded preceding and current row)"
    seen = both.withColumns({"reached": F.expr(up), "next": F.expr(down)})
    return seen.where("not base and coalesce(reached, 0) <= start and coalesce(next, end) >= end").select("rid", "start", "end")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, an array of (start, end) for each base kind, and one for ``context``."""
    facts = facts_of(docs)
    found = context_spans(docs, facts).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("context"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return facts.drop("tokens").join(found, "rid", "left").withColumn("context", F.coalesce("context", empty)).drop("rid")


def personal_data_digests(found: DataFrame) -> DataFrame:
    """Counts, the base spans' hash and all spans as text."""
    base = F.concat(*(_spans(k, k) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _spans("context", "context")), ",").alias("spans"),
    )
