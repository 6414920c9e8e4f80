"""Matching noisy symbols to known ones, and searching an instrument table.

Both work on distinct texts and pair them by equality on rare text pieces; a
candidate pair is verified by expressions. No text is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions import scalar as X
from tickloom.functions.ranking import range_numbers
from tickloom.session import materialise


def _trigrams(word: Column) -> Column:
    """All trigrams of ``$word^`` with repeats."""
    w = F.concat(F.lit("$"), word, F.lit("^"))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(w, i, F.lit(3)))


#: Queries of up to so many letters find near spellings by deletions, longer ones by their rarest trigrams.
SHORT = 12


def _without_one(word: Column) -> Column:
    """The word with each letter left out in turn."""
    n = F.length(word)
    cut = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))
    )
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def deletions(word: Column, most: int) -> Column:
    """The word and all that is left of it without up to ``most`` letters.

    Two words within that many edits have one of these in common: each edit is undone by leaving out one letter
    of one or of both.
    """
    keys = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, _without_one)))
        keys = F.concat(keys, last)
    return F.array_distinct(keys)


def _rarest(occ: DataFrame, group: list[str], most: Column) -> DataFrame:
    """The ``most`` rarest trigrams of each group, by column df."""
    w = Window.partitionBy(*group).orderBy(F.coalesce("df", F.lit(0)), "tg")
    rows = occ.select("*", F.row_number().over(w).alias("_r"), most.alias("_most"))
    return rows.filter("_r <= _most").select(*group, "tg").distinct()


def _dice_pairs(words: DataFrame, cand: DataFrame, dice: float) -> DataFrame:
    """(q, c) that may have the Dice coefficient: they share one of the rarest trigrams of q among words of c's length.

    A word of n letters has n trigrams, so the length says how many must be shared; of q's trigrams so many less
    one may be missing, and one of any larger number of them is not.
    """
    postings = cand.select("c", F.length("c").alias("n"), F.explode(F.array_distinct("c_tg")).alias("tg"))
    df = postings.groupBy("tg", "n").agg(F.count("*").alias("df"))
    ratio, size = (2 - dice) / dice, F.length("q")
    # Repeats in q count each, so a shorter word may share more trigrams than it has.
    lengths = F.sequence(F.lit(1), F.floor(size * ratio + 1e-9).cast("int"))
    occ = words.select("q", F.explode(lengths).alias("n"), _trigrams(F.col("q")).alias("q_tg"))
    occ = occ.select("q", "n", F.explode("q_tg").alias("tg")).join(df, ["tg", "n"], "left")
    must = F.greatest(F.ceil(dice / 2 * (size + F.col("n")) - 1e-9), F.lit(1))
    rare = _rarest(occ, ["q", "n"], size - must + 1)
    return rare.join(postings, ["tg", "n"]).select("q", "c")


def _edit_pairs(words: DataFrame, cand: DataFrame, max_edit: int) -> DataFrame:
    """(q, c) that may be within ``max_edit`` edits."""
    short = words.filter(F.length("q") <= SHORT).select("q", F.explode(deletions(F.col("q"), max_edit)).alias("key"))
    keys = cand.filter(F.length("c") <= SHORT + max_edit).select("c", F.explode(deletions(F.col("c"), max_edit)).alias("key"))
    near = short.join(keys, "key").select("q", "c")
    # An edit touches at most three trigrams, so of more than that one is left, and the rarest will do.
    postings = cand.select("c", F.explode(F.array_distinct("c_tg")).alias("tg"))
    df = postings.groupBy("tg").agg(F.count("*").alias("df"))
    long = words.filter(F.length("q") > SHORT).select("q", F.explode(_trigrams(F.col("q"))).alias("tg")).join(df, "tg", "left")
    return near.unionByName(_rarest(long, ["q"], F.lit(3 * max_edit + 1)).join(postings, "tg").select("q", "c"))


def fuzzy_match(
    queries: DataFrame, candidates: DataFrame, dice: float = 0.7, max_edit: int = 2
) -> DataFrame:
    """``queries`` (query) with the matching candidate (symbol) or NULL.

    Exact; else best trigram Dice of at least ``dice``; else the nearest candidate
    within ``max_edit`` edits that shares a trigram. Ties: more shared trigrams (edit
    distance only), then the lexically first.

    Candidates for Dice are joined on a query's rarest trigrams among words of one length, candidates for edits
    on what both are without a few letters. Frequent trigrams are never joined on, those of short queries too.
    """
    q = queries.select("query", X.clean_symbol(F.col("query")).alias("q"))
    words = q.select("q").filter("q <> ''").distinct()
    known = candidates.select(F.col("symbol").alias("c")).distinct()
    exact = words.join(known, F.col("q") == F.col("c"))
    rest = words.join(known, F.col("q") == F.col("c"), "left_anti")

    cand = known.filter("c <> ''").withColumn("c_tg", _trigrams(F.col("c")))
    pairs = _dice_pairs(rest, cand, dice).unionByName(_edit_pairs(rest, cand, max_edit)).distinct()
    pairs = pairs.withColumns({"q_tg": _trigrams(F.col("q")), "c_tg": _trigrams(F.col("c"))})
    shared = F.size(F.filter("q_tg", lambda t: F.array_contains("c_tg", t)))
    scored = pairs.select(
        "q",
        "c",
        shared.alias("shared"),
        (2.0 * shared / (F.size("q_tg") + F.size("c_tg"))).alias("dice"),
        F.levenshtein("q", "c", max_edit).alias("edit"),
    )
    by_dice = F.col("dice") >= dice
    by_edit = (F.col("edit") >= 0) & (F.col("edit") <= max_edit) & (F.col("shared") > 0)
    # One comparable key per pair; the best is a plain minimum, combined map-side.
    key = F.when(
        by_dice, F.struct(F.lit(0).alias("t"), (-F.col("dice")).alias("a"), F.lit(0).alias("b"), "c")
    ).when(
        by_edit,
        F.struct(F.lit(1).alias("t"), F.col("edit").cast("double").alias("a"), (-F.col("shared")).alias("b"), "c"),
    )
    near = scored.groupBy("q").agg(F.min(key).alias("k")).filter("k IS NOT NULL").select("q", F.col("k.c").alias("c"))
    found = exact.select("q", "c").unionByName(near)
    return q.join(found, "q", "left").select("query", F.col("c").alias("symbol"))


# --- search -----------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.filter(F.split(F.replace(F.upper(text), F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")


def _month_words() -> dict[str, str]:
    return {w: m for m, words in K.MONTH_WORDS.items() for w in words}


def build_search_index(instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with their name tokens, vocabulary with document frequency and idf).

    ``instruments``: entry_id, symbol, display, inst_type, expiry, strike, opt_type,
    month_tag, company. Derivatives take the tokens of their equity.
    """
    ignored = K.STOP_WORDS + K.INDEX_IGNORED + list(_month_words())
    text = F.concat_ws(" ", "symbol", F.coalesce("company", F.lit("")), "display")
    own = F.array_sort(
        F.filter(F.array_distinct(_words(text)), lambda w: ~w.isin(*ignored) & ~w.rlike(r"^[0-9]+$"))
    )
    rows = instruments.withColumn("own", own)
    equity = (
        rows.filter("inst_type = 'EQ'")
        .groupBy("symbol")
        .agg(F.max(F.struct("entry_id", "own")).alias("e"))
        .select("symbol", F.col("e.own").alias("eq_tokens"))
    )
    entries = (
        rows.join(equity, "symbol", "left")
        .withColumn(
            "tokens",
            F.when(F.col("inst_type") == "EQ", F.col("own")).otherwise(F.coalesce("eq_tokens", "own")),
        )
        .drop("own", "eq_tokens")
    )
    total = instruments.agg(F.count("*")).scalar()
    vocab = (
        entries.select(F.explode("tokens").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", F.log(total / F.col("df")) + 1.0)
    )
    return entries, vocab


def parse_queries(queries: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(query) to name tokens, month, option type, future flag and strike."""
    months = _month_words()
    parts = F.filter(_words(F.trim("query")), lambda w: ~w.isin(*K.STOP_WORDS))
    if aliases:
        parts = F.transform(parts, lambda w: F.coalesce(X.lookup(aliases, w), w))

    def number(w: Column) -> Column:
        return F.when(w.rlike(r"^[+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), w.try_cast("double"))

    special = list(months) + K.CALL_WORDS + K.PUT_WORDS + K.FUTURE_WORDS
    sides = F.filter("parts", lambda w: w.isin(*(K.CALL_WORDS + K.PUT_WORDS)))
    numbers = F.filter(
        F.transform(F.filter("parts", lambda w: ~w.isin(*special)), number), lambda v: v > 0
    )
    month = F.element_at(F.filter("parts", lambda w: w.isin(*months)), -1)
    return (
        queries.select("query", parts.alias("parts"))
        .select(
            "query",
            F.filter("parts", lambda w: ~w.isin(*special) & number(w).isNull()).alias("name_tokens"),
            X.lookup(months, F.when(F.exists("parts", lambda w: w.isin(*months)), month)).alias("month"),
            F.when(F.size(sides) > 0, F.when(F.element_at(sides, -1).isin(*K.CALL_WORDS), "CE").otherwise("PE")).alias("opt"),
            F.exists("parts", lambda w: w.isin(*K.FUTURE_WORDS)).alias("want_fut"),
            F.when(F.size(numbers) > 0, F.bround(F.element_at(numbers, -1)).cast("long")).alias("strike_int"),
        )
        .filter(F.length("query") >= 2)
    )


def _subsequence(token: Column) -> Column:
    """Pattern matching words that contain the token's characters in order."""
    return F.regexp_replace(token, r"(.)", r"\\Q$1\\E.*")


#: Words of a block of the sorted vocabulary, as a power of two, and levels of blocks.
BLOCK_BITS, BLOCK_LEVELS = 6, 3


def number_words(vocab: DataFrame) -> DataFrame:
    """``vocab`` with the place (from 0) of each word in their order."""
    rows = range_numbers(vocab.withColumn("_all", F.lit(0)), "_all", [F.col("word")], "number")
    return rows.withColumn("number", F.col("number") - 1).drop("_all")


def prefix_intervals(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, lo, hi, df): the numbered words that begin with the token are neighbours, so one row holds them all."""
    prefixes = vocab.select(
        "number", "df", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring("word", F.lit(1), n))).alias("token")
    )
    spans = prefixes.groupBy("token").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.sum("df").alias("df"))
    return tokens.join(spans, "token")


def _struct_with(level: Column):
    return lambda b: F.struct(level, b.alias("blk"))


def interval_blocks(intervals: DataFrame) -> DataFrame:
    """(token, level, blk): whole blocks of the levels that together are the interval, coarse ones in its middle."""
    parts = []
    for k in range(BLOCK_LEVELS):
        width = 1 << (BLOCK_BITS * k)
        lo, hi = F.ceil(F.col("lo") / width).cast("long"), F.floor((F.col("hi") + 1) / width).cast("long")
        if k + 1 < BLOCK_LEVELS:
            # What the next level covers, in blocks of this one; none if it covers nothing.
            wide = width << BLOCK_BITS
            above, upto = F.ceil(F.col("lo") / wide).cast("long"), F.floor((F.col("hi") + 1) / wide).cast("long")
            has = above < upto
            left = F.when(has, above * (1 << BLOCK_BITS)).otherwise(hi)
            right = F.when(has, upto * (1 << BLOCK_BITS)).otherwise(hi)
            spans = [(lo, left), (right, hi)]
        else:
            spans = [(lo, hi)]
        for x, y in spans:
            level = F.lit(k).alias("level")
            one = F.when(x < y, F.transform(F.sequence(x, y - 1), _struct_with(level)))
            parts.append(F.coalesce(one, F.array().cast("array<struct<level:int,blk:bigint>>")))
    return intervals.select("token", F.inline(F.concat(*parts)))


def loose_words(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, number, df) of the words that have the token's characters in order.

    Joined by the first and last character in order, then verified.
    """
    chars = F.split("word", "")
    ends = F.flatten(
        F.transform(
            chars,
            lambda a, i: F.transform(
                F.slice(chars, i + 1, F.size(chars)), lambda b, j: F.when(j > 0, F.concat(a, b)).otherwise(a)
            ),
        )
    )
    keyed = vocab.select("word", "number", "df", F.explode(F.array_distinct(ends)).alias("key"))
    key = F.when(F.length("token") == 1, F.col("token")).otherwise(
        F.concat(F.substring("token", 1, 1), F.substring("token", -1, 1))
    )
    found = tokens.withColumn("key", key).join(keyed, "key").filter(F.regexp_like("word", _subsequence(F.col("token"))))
    return found.select("token", "number", "df")


def match_tokens(tokens: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, loose, df) of distinct tokens that match, and (token, level, blk), the blocks of words that they match.

    Words with the prefix; if there is none, words with the subsequence (``loose``). df is how often they are
    in documents.
    """
    spans = materialise(prefix_intervals(tokens, vocab), "prefixes")
    rest = materialise(loose_words(tokens.join(spans.select("token"), "token", "left_anti"), vocab), "loose")
    known = spans.select("token", F.lit(False).alias("loose"), "df").unionByName(
        rest.groupBy("token").agg(F.lit(True).alias("loose"), F.sum("df").alias("df"))
    )
    single = rest.select("token", F.lit(0).alias("level"), F.col("number").alias("blk"))
    return known, interval_blocks(spans).unionByName(single)


def search_instruments(
    queries: DataFrame, instruments: DataFrame, limit: int, aliases: dict[str, str] | None = None
) -> DataFrame:
    """Best ``limit`` instruments per distinct query, with their scores.

    Names are matched per document, (symbol, tokens), which all contracts of an underlying share. Documents of a
    query's rarest token are tested for its other tokens; only if none has all of them, the documents of each
    token come in. No document behind the first ``limit`` (by score, then by its best contract) can have a
    contract among the first ``limit``, so only those documents meet their contracts, of which each brings its
    first ``limit``.
    """
    entries, vocab = build_search_index(instruments)
    entries = entries.withColumn("doc", F.xxhash64("symbol", F.array_join("tokens", " ")))
    # Several branches read each of these: tokenise and parse once.
    entries, vocab = materialise(entries, "entries"), materialise(number_words(vocab), "vocab")
    parsed = materialise(parse_queries(queries.select("query").distinct(), aliases), "queries")
    docs = materialise(entries.groupBy("doc").agg(F.first("symbol").alias("symbol"), F.first("tokens").alias("tokens")), "docs")

    asked = parsed.select("query", F.posexplode("name_tokens").alias("pos", "token"))
    known, blocks = match_tokens(asked.select("token").distinct(), vocab)
    postings = docs.select("doc", F.explode("tokens").alias("word")).join(vocab.select("word", "number"), "word")
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("number", BLOCK_BITS * k).alias("blk")) for k in range(BLOCK_LEVELS)])
    token_docs = materialise(blocks.join(postings.select("doc", F.inline(levels)), ["level", "blk"]).select("token", "doc").distinct(), "hits")

    weighed = asked.join(known, "token", "left").join(vocab.select(F.col("word").alias("token"), "idf"), "token", "left")
    one = F.struct("token", F.coalesce("idf", F.lit(1.0)).alias("idf"), "loose")
    asks = weighed.groupBy("query").agg(
        F.collect_list(one).alias("toks"),
        F.min(F.struct("df", "pos", "token"))["token"].alias("token"),
        F.bool_and(F.col("df").isNotNull()).alias("able"),
    )
    asks = materialise(asks, "asks")
    sym = F.col("symbol")

    def hit(t: Column) -> Column:
        tok = t["token"]
        return F.when(t["loose"], F.exists("tokens", lambda w: F.regexp_like(w, _subsequence(tok)))).otherwise(
            F.exists("tokens", lambda w: w.startswith(tok))
        )

    every_hit = asks.filter("able").join(token_docs, "token").join(docs, "doc").filter(F.forall("toks", hit))
    every_hit = materialise(every_hit.select("query", "doc", F.lit(True).alias("used_and")), "all")
    some = asked.join(every_hit.select("query").distinct(), "query", "left_anti").join(token_docs, "token")
    chosen = every_hit.unionByName(some.select("query", "doc", F.lit(False).alias("used_and")).distinct())

    def points(t: Column) -> Column:
        tok, weight = t["token"], t["idf"] * K.SCORE_IDF
        seq = _subsequence(tok)
        near = sym.startswith(tok) | tok.startswith(sym)
        return (
            F.when(sym == tok, K.SCORE_EXACT + weight)
            .when(near, K.SCORE_PREFIX + weight)
            .when(F.regexp_like(sym, seq), K.SCORE_PREFIX * 0.5 + weight * 0.5)
            .when(F.array_contains("tokens", tok), weight)
            .when(F.exists("tokens", lambda w: w.startswith(tok)), weight * 0.8)
            .when(F.exists("tokens", lambda w: F.regexp_like(w, seq)), weight * 0.4)
        )

    got = F.transform("toks", points)
    total = F.aggregate(got, F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))
    every = F.forall(got, lambda p: p.isNotNull())
    named = (
        chosen.join(docs, "doc")
        .join(asks.select("query", "toks"), "query")
        .select("query", "doc", (total + F.when(F.col("used_and") & every, K.SCORE_ALL).otherwise(0.0)).alias("score"))
    )

    offers = materialise(_offers(parsed, entries, limit), "offers")
    attrs = parsed.select("query", (F.size("name_tokens") > 0).alias("named"), _attributes().alias("combo"))
    best = offers.filter("nth = 1").select("combo", "doc", F.col("key").alias("best"))
    w = Window.partitionBy("query").orderBy(F.desc(F.col("score") - F.col("best.less")), "best.expiry", "best.strike", "best.entry_id")
    kept = (
        named.join(attrs.select("query", "combo"), "query")
        .join(best, ["combo", "doc"])
        .withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= limit)
        .select("query", "combo", "doc", "score")
    )
    rows = kept.join(offers.drop("nth"), ["combo", "doc"]).select("query", "score", "key")
    # Queries without a name take the first contracts that have their attributes.
    first = Window.partitionBy("combo").orderBy("key")
    plain = attrs.filter("NOT named").select("query", "combo")
    top = offers.join(plain.select("combo").distinct(), "combo").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= limit)
    rows = rows.unionByName(plain.join(top, "combo").select("query", F.lit(0.0).alias("score"), "key"))
    rows = rows.select("query", (F.col("score") - F.col("key.less")).alias("score"), "key.*").drop("less")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "expiry", "strike", "entry_id")
    rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query", "rank", "score", "entry_id")
    shown = entries.select("entry_id", "symbol", "display", "inst_type", "expiry", "strike", "opt_type")
    return rows.join(shown, "entry_id").select(
        "query", "rank", "score", "entry_id", "symbol", "display", "inst_type", "expiry", "strike", "opt_type"
    )


def _attributes() -> Column:
    """What a query asks of a contract, as one comparable value; queries without any share one."""
    strike = F.coalesce(F.col("strike_int").cast("string"), F.lit(""))
    return F.concat_ws("|", F.coalesce("month", F.lit("")), F.coalesce("opt", F.lit("")), F.col("want_fut").cast("string"), strike)


def _offers(parsed: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """(combo, doc, key, nth): the first ``limit`` contracts of each document that have the attributes of a combination.

    key orders contracts: less (the bonus of equities, negative), expiry, strike, entry_id. Combinations and
    contracts meet on their most selective attribute.
    """
    combos = parsed.select(_attributes().alias("combo"), "month", "opt", "want_fut", "strike_int").distinct()
    want = (
        F.when(F.col("strike_int").isNotNull(), F.concat(F.lit("S"), F.col("strike_int").cast("string")))
        .when(F.col("month").isNotNull(), F.concat(F.lit("M"), "month"))
        .when(F.col("opt").isNotNull(), F.concat(F.lit("O"), "opt"))
        .when(F.col("want_fut"), "F")
        .otherwise("A")
    )
    has = F.array_compact(
        F.array(
            F.when(F.col("strike") > 0, F.concat(F.lit("S"), F.col("strike").cast("long").cast("string"))),
            F.concat(F.lit("M"), "month_tag"),
            F.concat(F.lit("O"), "opt_type"),
            F.when(F.col("inst_type") == "FUT", "F"),
            F.lit("A"),
        )
    )
    rows = combos.withColumn("_want", want).join(entries.withColumn("_want", F.explode(has)), "_want")
    opt, strike = F.col("opt"), F.col("strike_int")
    ok_opt = F.when(opt.isNotNull(), F.col("opt_type") == opt).when(F.col("want_fut"), F.col("inst_type") == "FUT").otherwise(True)
    ok_month = F.when(F.col("month").isNotNull(), F.col("month_tag") == F.col("month")).otherwise(True)
    ok_strike = F.when(strike.isNotNull(), (F.col("strike") > 0) & (F.col("strike") == strike)).otherwise(True)
    context = F.col("month").isNotNull() | (F.coalesce(strike, F.lit(0)) != 0) | opt.isNotNull() | F.col("want_fut")
    less = F.when((F.col("expiry") == "") & ~context, -float(K.SCORE_EQUITY)).otherwise(0.0)
    key = F.struct(less.alias("less"), "expiry", "strike", "entry_id")
    w = Window.partitionBy("combo", "doc").orderBy("key")
    rows = rows.filter(ok_opt & ok_month & ok_strike).select("combo", "doc", key.alias("key"))
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit)
