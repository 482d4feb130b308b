"""Message templates, mined with a fixed-depth tree over distinct messages.

The tree follows the published fixed-depth-tree log miner: messages are routed by token count and first token, and
inside such a leaf similar messages become one template, whose differing tokens are wildcards.

Spark does all of it. Messages are masked (tokens with a digit become wildcards) and reduced to distinct ones. The
templates of all leaves are then merged in rounds until none finds a partner: an inverted table of (leaf, position, token) names the
earliest template of each key; every template takes the one that is named most often by its own keys, if enough of their tokens are
equal, and joins it. Leaves of bounded size do their rounds in one task each; larger ones are merged by joins over all leaves,
round by round, and nothing holds one. The rounds are the same, so neither the partitioning nor any size decides about a template.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftline.functions.staging import once
from siftline.operators.numbering import number_by_rank
from siftline.session import discard, drop_shuffles, stage

WILDCARD = "<*>"

# Mining parameters.
SIMILARITY = 0.4
MAX_CHILDREN = 100

# Templates that one is compared with in a round.
COMPARED = 3

# Leaves of up to so many tokens (templates times their length) do their rounds in one task. A round by joins costs several times
# as much, as it explodes and shuffles every token.
LEAF_TOKENS = 1 << 24

# Leaves of the same length are put together up to about so many tokens, as each group has its fixed time.
PACK_TOKENS = 1 << 18

# Cells that a step of a leaf's rounds has in hand at once.
CELLS = 1 << 19

# From so many templates in a leaf on, earliest ones are found by writing to a place for each token instead of by sorting.
MANY_TEMPLATES = 512

# Template tables up to this many bytes are broadcast to the lines.
MAX_BROADCAST_BYTES = 64 << 20


def template_text(message: Column, raw: Column) -> Column:
    """The text to mine: the message, or the raw line when the message is missing or empty."""
    return F.coalesce(F.nullif(message, F.lit("")), raw)


def passthrough(parsed: DataFrame) -> DataFrame:
    """No mining: every text is its own template, cluster -1."""
    return parsed.withColumn("cluster_id", F.lit(-1).cast("bigint")).withColumn(
        "template", template_text(F.col("message"), F.col("raw"))
    )


def masked(text: Column) -> Column:
    """Tokens joined by one blank, tokens with a digit replaced by the wildcard."""
    # white space beside single blanks is rare: looked for in a way that is cheaper than to replace it
    odd = text.rlike(r"[^ -~\u00a1-\u167f]") | F.contains(text, F.lit("  "))
    tokens = F.trim(F.when(odd, F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text))
    # starts at token starts only and never backtracks: linear in the text
    marked = F.regexp_replace(tokens, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", WILDCARD)
    return F.when(text.rlike("[0-9]"), marked).otherwise(tokens)


def _shape(text: str) -> Column:
    """The masked text; a missing one is empty."""
    return masked(F.coalesce(F.col(text), F.lit("")))


def _digest(text: Column) -> Column:
    """32 bytes that stand for a text of any length in shuffles."""
    return F.unhex(F.sha2(text, 256))


def distinct_shapes(texts: DataFrame, text: str, order: str) -> DataFrame:
    """``shape, n, first_seq``: distinct masked texts, counted before the shuffle."""
    shapes = texts.select(_shape(text).alias("shape"), F.col(order).alias("_seq"))
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("first_seq"))


def _measured(table: DataFrame, row_bytes: int, max_broadcast_bytes: int) -> DataFrame:
    """A staged table of narrow rows, to be broadcast if their number allows it."""
    return F.broadcast(table) if row_bytes * table.count() <= max_broadcast_bytes else table


def _route(shapes: DataFrame, max_children: int, max_broadcast_bytes: int) -> DataFrame:
    """Add the leaf: token count and first token, or the wildcard beyond the child limit."""
    named = shapes.where(F.col("_first") != WILDCARD)
    tokens = named.groupBy("n_tokens", "_first").agg(F.min("first_seq").alias("_seen"))
    rank = F.row_number().over(W.partitionBy("n_tokens").orderBy("_seen", "_first"))
    # The limit is pushed into the window, so only candidates of the first
    # ``max_children`` leave their partition.
    kept = tokens.withColumn("_rank", rank).where(F.col("_rank") < max_children)
    kept = stage(kept.select("n_tokens", "_first", F.col("_first").alias("_branch")), "branches")
    width = kept.agg(F.coalesce(F.sum(2 * F.octet_length("_first") + 64), F.lit(0))).first()[0]
    joined = shapes.join(F.broadcast(kept) if width <= max_broadcast_bytes else kept, ["n_tokens", "_first"], "left")
    return joined.withColumn("branch", F.coalesce("_branch", F.lit(WILDCARD))).drop("_first", "_branch")


_LEAF = ["n_tokens", "branch"]


def _tokens(template: str = "template") -> Column:
    return F.split(template, " ")


def _given(n_tokens: Column, branch: Column) -> Column:
    """How many tokens the leaf itself says to be equal: the first one of a named branch (short messages need it as a key)."""
    return F.when((branch == WILDCARD) | (n_tokens <= 2), 0).otherwise(1)


def _keys(live: DataFrame) -> DataFrame:
    """``id, key``: every (leaf, position, token) of the templates, without wildcards and tokens that the leaf gives."""
    tokens = live.select("id", "n_tokens", "branch", F.posexplode(_tokens()).alias("pos", "token"))
    own = (F.col("token") != WILDCARD) & (F.col("pos") >= _given(F.col("n_tokens"), F.col("branch")))
    # 64 bits suffice: a collision could only name a template that is compared in full afterwards
    return tokens.where(own).select("id", F.xxhash64("n_tokens", "branch", "pos", "token").alias("key"))


def _partners(live: DataFrame, max_broadcast_bytes: int) -> DataFrame:
    """``id, rep, mask, near``: earlier templates that may be like each one, and which of their tokens are equal (1) or not (0).

    Each key names its earliest template; counting is combined before the shuffle, so a token that a
    third of all templates share costs one row of each task. A template is compared with the ``COMPARED`` ones that
    its keys name most often (then the earlier), and ``near`` if enough tokens are equal. Templates of which not enough
    tokens are named are left out: they can't have a partner, now or later, since others only lose tokens.
    """
    named = _keys(live).groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    named = _measured(stage(named.where("n > 1").select("key", "rep"), "named"), 48, max_broadcast_bytes)
    votes = _keys(live.where("able")).join(named, "key").where("id <> rep").repartition("id")
    votes = votes.groupBy("id", "rep").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct("n", (-F.col("rep")).alias("minus"))), asc=False)  # one for a key at most
    best = votes.groupBy("id").agg(F.slice(ranked, 1, COMPARED).alias("best"), F.sum("n").alias("named"))
    own = live.select("id", "n_tokens", "branch", _tokens().alias("a"))
    enough = (F.col("named") + _given(F.col("n_tokens"), F.col("branch"))) / F.col("n_tokens") >= SIMILARITY
    able = best.join(own, "id").where(enough)
    able = able.select("id", "n_tokens", "a", F.explode("best").alias("one")).withColumn("rep", -F.col("one.minus"))
    other = live.select(F.col("id").alias("rep"), _tokens().alias("b"))
    equal = F.zip_with("a", "b", lambda a, b: F.when((a == b) & (a != WILDCARD), F.lit("1")).otherwise(F.lit("0")))
    pairs = able.join(other, "rep").select("id", "rep", "n_tokens", F.array_join(equal, "").alias("mask"))
    return pairs.select("id", "rep", "mask", (_ones("mask") / F.col("n_tokens") >= SIMILARITY).alias("near"))


def _ones(mask: str) -> Column:
    return F.char_length(F.replace(mask, F.lit("0"), F.lit("")))


def _joins(edges: DataFrame) -> DataFrame:
    """``id, rep, chosen``: what joins in this round, and the tokens that its new template keeps.

    A template that is near an earlier one moves; each one that moves joins the most similar that doesn't, of those it was compared with, or
    waits. The masks of a template's joiners are
    taken in turn, those that most share first (then those with more tokens equal), as long as the tokens equal in all of them
    are enough; all whose equal tokens include these join.
    """
    moving = edges.select(F.col("id").alias("rep")).distinct()
    still = edges.join(moving, "rep", "left_anti")
    most = F.max(F.struct(_ones("mask").alias("ones"), (-F.col("rep")).alias("minus"), "mask"))
    still = still.groupBy("id").agg(most.alias("best")).select("id", (-F.col("best.minus")).alias("rep"), "best.mask")
    masks = still.groupBy("rep", "mask").agg(F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("n"), F.desc(_ones("mask")), F.desc("mask")))
    # the turn in which each token is first not equal; the one that would leave too few tokens is the first not taken
    masks = masks.select("rep", "mask", turn.alias("turn"))  # by itself: a generator beside a window would come before it
    lost = masks.select("rep", F.char_length("mask").alias("width"), "turn", F.posexplode(F.split("mask", "")).alias("pos", "bit"))
    lost = lost.groupBy("rep", "width", "pos").agg(F.min(F.when(F.col("bit") == "0", F.col("turn"))).alias("turn"))
    places = F.array_sort(F.collect_list(F.struct("pos", "turn")))  # as many as the message has tokens
    wide = lost.groupBy("rep", "width").agg(places.alias("places"))
    turns = F.array_sort(F.transform("places", lambda p: p["turn"]))  # null last
    spare = F.col("width") - F.ceil(F.round(F.col("width") * SIMILARITY, 6)).cast("int")
    wide = wide.withColumn("end", F.try_element_at(turns, spare + 1))
    gone = F.transform("places", lambda p: F.when(p["turn"] < F.coalesce("end", F.lit(1 << 30)), F.lit("0")).otherwise(F.lit("1")))
    chosen = wide.select("rep", F.array_join(gone, "").alias("chosen"))
    return still.join(chosen, "rep").where(F.expr("mask LIKE replace(chosen, '0', '_')")).select("id", "rep", "chosen")


def _merged(live: DataFrame, partners: DataFrame, joins: DataFrame) -> DataFrame:
    """The templates that can go on: those that were joined, and those that may yet join others."""
    kept = joins.select(F.col("rep").alias("id"), "chosen").distinct()
    letters = F.transform(_tokens(), lambda t, i: F.when(F.substr("chosen", i + 1, F.lit(1)) == "1", t).otherwise(F.lit(WILDCARD)))
    wild = F.when(F.col("chosen").isNull(), F.col("template")).otherwise(F.array_join(letters, " "))
    able = partners.select("id").distinct().join(joins.select("id"), "id", "left_anti").withColumn("able", F.lit(True))
    going = able.join(kept, "id", "full").join(live.drop("able"), "id")
    return going.select(
        "id",
        "n_tokens",
        "branch",
        wild.alias("template"),
        F.coalesce("able", F.lit(False)).alias("able"),
        F.col("chosen").isNotNull().alias("new"),
    )


def _numbered(texts: pd.Series | pa.ChunkedArray) -> tuple[np.ndarray, pd.api.extensions.ExtensionArray]:
    """Texts of equally many tokens as rows of numbers (0: the wildcard), and the token of each number."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [pa.array(texts)]
    flat = [pc.split_pattern(chunk.cast(pa.large_string()), " ").flatten() for chunk in chunks]
    tokens = pa.chunked_array(flat).dictionary_encode().combine_chunks()
    number = np.arange(1, len(tokens.dictionary) + 1, dtype=np.int32)
    wild = pc.index(tokens.dictionary, pa.scalar(WILDCARD, pa.large_string())).as_py()
    if wild >= 0:
        number[wild] = 0
    words = pa.concat_arrays([pa.array([WILDCARD], pa.large_string()), tokens.dictionary])
    return number[tokens.indices.to_numpy()].reshape(len(texts), -1), pd.arrays.ArrowExtensionArray(words)


def _earliest(here: np.ndarray, leaf: np.ndarray, given: np.ndarray, n_words: int) -> np.ndarray:
    """The earliest row of the same leaf with the same token there, for each cell; -1 if that is the row itself or for a wildcard.

    Rows are sorted by ``leaf``. The first tokens of rows that have one ``given`` name none.
    """
    n, width = here.shape
    at, named = np.arange(n, dtype=np.int32), np.empty((n, width), np.int32)
    if n >= MANY_TEMPLATES and leaf[0] == leaf[-1]:
        place = np.empty(n_words, np.int32)
        for p in range(0, width, 16):  # a line of cache
            columns = np.ascontiguousarray(here[:, p : p + 16].T)
            found = np.empty_like(columns)
            for column, to in zip(columns, found):
                place[column[::-1]] = at[::-1]  # of equal tokens the earliest is written last
                np.take(place, column, out=to)
            found[(found == at) | (columns == 0)] = -1
            named[:, p : p + 16] = found.T
    else:
        step = max(1, CELLS // n)
        for p in range(0, width, step):
            order = here[:, p : p + step].T.astype(np.int64) << 32 | at
            order.sort(axis=1)
            token, row = order >> 32, order & 0xFFFFFFFF
            new = np.ones(order.shape, bool)
            new[:, 1:] = (token[:, 1:] != token[:, :-1]) | (leaf[row[:, 1:]] != leaf[row[:, :-1]])
            first = np.take_along_axis(row, np.maximum.accumulate(np.where(new, at, 0), axis=1), axis=1)
            found = np.empty(order.shape, np.int32)
            np.put_along_axis(found, row, np.where((first == row) | (token == 0), -1, first).astype(np.int32), axis=1)
            named[:, p : p + step] = found.T
    named[given > 0, 0] = -1
    return named


def _most_named(named: np.ndarray) -> np.ndarray:
    """For each row the ``COMPARED`` values that it holds most often (then the smaller), -1 where it has no more. A row has one at least."""
    order = np.sort(named, axis=1).ravel()
    new = np.ones(order.shape, bool)
    new[1:] = order[1:] != order[:-1]
    new[:: named.shape[1]] = True
    at = np.flatnonzero(new)
    value, times, row = order[at].astype(np.int64), np.diff(at, append=len(order)), at // named.shape[1]
    own = value >= 0
    row, score = row[own], ((times << 32) - value)[own]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    lengths = np.diff(starts, append=len(row))
    found = np.empty((len(named), COMPARED), np.int64)
    for k in range(COMPARED):
        best = np.maximum.reduceat(score, starts)
        found[:, k] = np.where(best > 0, -best & 0xFFFFFFFF, -1)
        score[score == np.repeat(best, lengths)] = 0
    return found


def _near(here: np.ndarray, named: np.ndarray, able: np.ndarray) -> np.ndarray:
    """``row, partner, equal tokens`` of the rows ``able`` and those of the compared ones that are near."""
    found, step = [np.empty((0, 3), np.int64)], max(1, CELLS // here.shape[1])
    for begin in range(0, len(able), step):
        rows = able[begin : begin + step]
        for partner in _most_named(named[rows]).T:
            row, partner = rows[partner >= 0], partner[partner >= 0]
            equal = ((here[row] == here[partner]) & (here[row] != 0)).sum(axis=1)
            near = equal / here.shape[1] >= SIMILARITY
            found.append(np.stack([row, partner, equal], axis=1)[near])
    return np.concatenate(found)


def _chosen(masks: np.ndarray) -> np.ndarray:
    """The tokens that a template keeps, by the equal tokens of those that may join it."""
    if len(masks) == 1:
        return masks[0]
    shared = Counter(mask.tobytes() for mask in masks)
    chosen = np.ones(masks.shape[1], bool)
    for mask in sorted(shared, key=lambda m: (shared[m], sum(m), m), reverse=True):
        narrower = chosen & np.frombuffer(mask, bool)
        if narrower.sum() / len(chosen) < SIMILARITY:
            break
        chosen = narrower
    return chosen


_ROUNDS = pa.schema([("id", pa.int64()), ("rep", pa.int64()), ("template", pa.string())])


def _leaf_rounds(group: pa.Table) -> pa.Table:
    """All rounds of leaves of equal length and bounded size, by the rules of ``_partners``, ``_joins`` and ``_merged``.

    ``id, rep, template``: what each one joined, or else its template if it was joined. Leaves don't meet, and each ends with
    its first round without a partner. Nothing is said of templates without an id, nor of those that joined one.
    """
    order = pc.sort_indices(group, [(c, "ascending") for c in ("branch", "id", "template")]).to_numpy()
    rows, words = _numbered(group["template"])
    rows, width = rows[order], rows.shape[1]
    branch = group["branch"].combine_chunks().dictionary_encode()
    wild = pc.equal(group["branch"], WILDCARD).to_numpy()[order]
    leaf, given = branch.indices.to_numpy()[order], np.where(wild | (width <= 2), 0, 1)
    live, able = np.arange(len(rows)), group["able"].to_numpy()[order]
    joined, led = np.full(len(rows), -1), np.zeros(len(rows), bool)
    while len(live):
        here = rows[live]
        named = _earliest(here, leaf[live], given[live], len(words))
        known = (named >= 0).sum(axis=1)
        able[live] &= (known > 0) & ((known + given[live]) / width >= SIMILARITY)
        near = _near(here, named, np.flatnonzero(able[live]))
        if not len(near):
            break
        moving = np.zeros(len(live), bool)
        moving[near[:, 0]] = True
        staying = near[~moving[near[:, 1]]]
        staying = staying[np.lexsort((staying[:, 1], -staying[:, 2], staying[:, 0]))]
        best = staying[np.diff(staying[:, 0], prepend=-1) > 0]
        best = best[np.argsort(best[:, 1], kind="stable")]
        reps, starts = np.unique(best[:, 1], return_index=True)
        for c, members in zip(reps, np.split(best[:, 0], starts[1:])):
            masks = (here[members] == here[c]) & (here[c] != 0)
            chosen = _chosen(masks)
            joined[live[members[masks[:, chosen].all(axis=1)]]] = live[c]
            rows[live[c], ~chosen] = 0
        led[live[reps]] = True
        leads = np.zeros(len(live), bool)
        leads[reps] = True
        going = np.isin(leaf[live], leaf[live[near[:, 0]]])
        live = live[going & (joined[live] < 0) & (able[live] | leads)]
    ids, known = group["id"].fill_null(-1).to_numpy()[order], group["id"].is_valid().to_numpy()[order]
    moved = np.flatnonzero((joined >= 0) & known & known[joined])
    made = np.flatnonzero(led & (joined < 0) & known)
    templates = words.take(rows[made].ravel()).to_numpy(object).reshape(len(made), width)
    joins = pa.table([ids[moved], ids[joined[moved]], pa.nulls(len(moved), pa.string())], schema=_ROUNDS)
    return pa.concat_tables(
        [joins, pa.table([ids[made], pa.nulls(len(made), pa.int64()), pa.array(map(" ".join, templates), pa.string())], schema=_ROUNDS)]
    )


def _split(live: DataFrame, leaf_tokens: int, max_broadcast_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The templates of leaves of bounded size (and two at least) with the pack of each leaf, and those of larger ones, if any."""
    sizes = live.groupBy(*_LEAF).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = sizes.select(*_LEAF, (F.col("_n") * F.col("n_tokens")).alias("_size"))
    # a leaf that fills a pack has one to itself
    sizes = sizes.withColumn("_alone", F.col("_size") >= PACK_TOKENS)
    before = F.sum("_size").over(W.partitionBy("n_tokens", "_alone").orderBy("branch")) - F.col("_size")
    sizes = stage(sizes.withColumn("_pack", F.call_function("div", before, F.lit(PACK_TOKENS))), "leaves")
    size = F.octet_length("branch") + 64
    bytes_, largest = sizes.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    sized = live.join(F.broadcast(sizes) if bytes_ <= max_broadcast_bytes else sizes, _LEAF)
    bounded = F.col("_size") <= leaf_tokens
    large = sized.where(~bounded).drop("_size", "_alone", "_pack") if largest > leaf_tokens else None
    return sized.where(bounded).drop("_size"), large


def _mined(
    texts: DataFrame, text: str, order: str, max_children: int, max_broadcast_bytes: int, leaf_tokens: int
) -> tuple[DataFrame, DataFrame]:
    """``shape, n, first_seq`` of every distinct masked text, and ``first_seq, template`` of those that were merged."""
    # Everything after this line works on distinct messages only.
    shapes = distinct_shapes(texts, text, order)
    blanks = F.octet_length("shape") - F.octet_length(F.replace("shape", F.lit(" "), F.lit("")))
    shapes = shapes.withColumn("n_tokens", blanks + 1).withColumn("_first", F.substring_index("shape", " ", 1))
    shapes = stage(shapes, "shapes")
    drop_shuffles(texts.sparkSession)
    routed = _route(shapes, max_children, max_broadcast_bytes)
    live = routed.select(
        F.col("first_seq").alias("id"), "n_tokens", "branch", F.col("shape").alias("template"), F.lit(True).alias("able")
    )
    links, changed = [], []  # of each round
    while True:
        small, live = _split(live, leaf_tokens, max_broadcast_bytes)
        rounds = small.groupBy("n_tokens", "_alone", "_pack").applyInArrow(_leaf_rounds, "id BIGINT, rep BIGINT, template STRING")
        rounds = stage(rounds, "leaf_rounds")
        links.append(rounds.where("rep IS NOT NULL").select("id", "rep"))
        changed.append(rounds.where("rep IS NULL").select("id", "template"))
        if live is None:
            break
        partners = stage(_partners(live, max_broadcast_bytes), "partners")
        edges = partners.where("near").drop("near")
        if edges.isEmpty():
            break
        joins = stage(_joins(edges), "joins")
        links.append(joins.select("id", "rep"))
        live = stage(_merged(live, partners, joins), "live")
        changed.append(live.where("new").select("id", "template"))
    # A text's template may have joined another one in a later round: follow the links, twice as far each time.
    # A template joins once, and what it was before is of no use then.
    ends = stage(reduce(DataFrame.union, links), "links")
    while True:
        on = ends.select(F.col("id").alias("rep"), F.col("rep").alias("further"))
        if ends.join(on, "rep", "left_semi").isEmpty():
            break
        ends = stage(ends.join(on, "rep", "left").select("id", F.coalesce("further", "rep").alias("rep")), "links")
    made = reduce(DataFrame.union, (c.withColumn("round", F.lit(i)) for i, c in enumerate(changed)))
    made = made.groupBy("id").agg(F.max_by("template", "round").alias("template")).withColumnRenamed("id", "rep")
    own = made.select(F.col("rep").alias("id"), "rep").join(ends.select("id"), "id", "left_anti")
    ends = ends.union(own).join(made, "rep").select(F.col("id").alias("first_seq"), "template")
    return shapes.select("shape", "n", "first_seq"), ends


def mine(
    texts: DataFrame,
    text: str,
    order: str = "seq",
    max_children: int = MAX_CHILDREN,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    leaf_tokens: int = LEAF_TOKENS,
) -> DataFrame:
    """``shape, template, n, first_seq``: the template of every distinct masked text. NULL texts count as empty.

    ``order`` is unique for each row. Leaves of up to ``leaf_tokens`` tokens are grouped. Of larger ones the first
    round shuffles a row for each token of the distinct texts; later ones work on the templates that were joined and
    those that may still join, and on fewer leaves.
    """
    shapes, merged = _mined(texts, text, order, max_children, max_broadcast_bytes, leaf_tokens)
    found = shapes.join(merged, "first_seq", "left")
    return found.select("shape", F.coalesce("template", "shape").alias("template"), "n", "first_seq")


def template_counts(mined: DataFrame) -> DataFrame:
    """``template, n, first_seq`` by final template."""
    return mined.groupBy("template").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))


def number_templates(mined: DataFrame) -> DataFrame:
    """``template, n, first_seq, cluster_id``: clusters numbered by first appearance, from 1."""
    return number_by_rank(template_counts(mined), "first_seq", "cluster_id")


def assign(
    lines: DataFrame,
    text: str,
    order: str = "seq",
    max_children: int = MAX_CHILDREN,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add ``cluster_id`` and ``template`` to every line.

    Texts are joined by their digests, and a template is carried only where it is not the masked text itself.
    The table of distinct texts is broadcast when its measured size allows it.
    Otherwise the lines are joined by shuffle, where adaptive execution splits
    the partition of a text that occurs very often.
    """
    shapes, merged = _mined(lines, text, order, max_children, max_broadcast_bytes, LEAF_TOKENS)
    narrow = shapes.select(_digest(F.col("shape")).alias("_digest"), "n", "first_seq").join(merged, "first_seq", "left")
    mined = stage(narrow.withColumn("_key", F.coalesce(_digest(F.col("template")), "_digest")), "mined")
    discard(shapes)
    clusters = number_templates(mined.select(F.col("_key").alias("template"), "n", "first_seq"))
    table = mined.join(clusters.select(F.col("template").alias("_key"), "cluster_id"), "_key")
    table = table.select("_digest", "cluster_id", F.col("template").alias("_merged"))
    # key, row and pointers: 404,191 rows with few templates took 78 MB when broadcast
    width = F.coalesce(F.octet_length("template"), F.lit(0)) + 176
    measured = mined.agg(F.sum(width.cast("bigint")).alias("b")).first().b or 0
    if measured <= max_broadcast_bytes:
        table = F.broadcast(table)
    bare = once(lines.drop("cluster_id", "template"), "_shape", _shape(text))
    # of a masked text only what the line doesn't say itself goes through the shuffle
    bare = bare.withColumn("_digest", _digest(F.col("_shape"))).withColumn("_shape", F.nullif("_shape", F.col(text)))
    template = F.coalesce("_merged", "_shape", text).alias("template")
    return bare.join(table, "_digest").select(*lines.drop("cluster_id", "template").columns, template, "cluster_id")
