"""Question -> packed context.

Only pairs of a query and a file that score become rows: names are matched by a shared
gram, terms by one scan of each file for the terms of its project. The file table is
never shuffled with its content. Packing (W1) runs in rounds: each round takes a list
bounded by the remaining budget, first from the scored files of a query, then from the
list of all files that the queries of a project share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as X
from quarry.functions.bounded import small
from quarry.operators.postings import occurrences
from quarry.operators.tree import tree_length, tree_rows
from quarry.session import checkpoint_dir, stored

# Fixed values of the reference's context selection.
FRAME_RX = r'File "(.*?)", line \d+'
FRAME_LINE_RX = r'File "(.*?)", line (\d+)'
FULL_PATH_SCORE = 50
BASENAME_SCORE = 30
MIN_TERM_CHARS = 4  # terms longer than 3 characters
HEADER_TOKENS = 20
TIME_TRAVEL_TOKENS = 20
DIFF_EXTRA_TOKENS = 10
TREE_HEADER = "PROJECT ARCHITECTURE:\n"
TREE_BLOCK = 256  # tree lines in a row of the context document
CONTEXT_SHARE = 0.6
MENTION_LIMIT = 3
# White space as Python's str.split has it.
SPACE_RX = r"(?U)[\s\x1c-\x1f]+"
#: Names are looked up by their first characters.
GRAM = 6


# ---------------------------------------------------------------- J9 / J10

def trace_frames(traces: DataFrame, key: str = "trace_id") -> DataFrame:
    """Frames ``File "...", line N`` in order: (key, pos, clean, line)."""
    f = traces.select(
        key,
        F.posexplode(F.arrays_zip(
            F.regexp_extract_all("text", F.lit(FRAME_LINE_RX), 1).alias("raw"),
            F.regexp_extract_all("text", F.lit(FRAME_LINE_RX), 2).alias("line"),
        )).alias("pos", "fr"),
    )
    return f.select(key, F.col("pos").cast("long").alias("pos"),
                    P.to_posix(F.col("fr.raw")).alias("clean"), F.col("fr.line").cast("long").alias("line"))


def stack_trace_files(traces: DataFrame, files: DataFrame, key: str = "trace_id", scope=None) -> DataFrame:
    """Frames resolved to context files by (1) exact path, (2) path suffix on a
    '/' boundary, (3) base name; the first file in ``ord`` order wins within a
    tier; distinct files keep the order of their first frame.

    Suffix matching is an equi-join on every '/'-suffix of the frame path. Files are
    pre-reduced to one row per path and per base name (partial aggregation), so a
    base name shared by millions of files cannot blow up the join.
    """
    sc = [scope] if scope else []
    fr = trace_frames(traces.select(key, "text", *sc), key)
    if scope:
        fr = fr.join(traces.select(key, scope), key)
    parts = F.split("clean", "/")
    sfx = fr.select(
        key, *sc, "pos",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("i", "cand"),
    ).where(F.col("cand") != "")
    by_path = files.groupBy(*sc, "path").agg(F.min("ord").alias("ord"))
    t12 = sfx.withColumnRenamed("cand", "path").join(by_path, [*sc, "path"]).select(
        key, "pos", "path", "ord", F.when(F.col("i") == 0, 1).otherwise(2).alias("tier")
    )
    by_name = files.groupBy(*sc, P.basename("path").alias("bn")).agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord"))
    fn = fr.select(key, *sc, "pos", F.element_at(F.split("clean", "/"), -1).alias("bn"))
    t3 = fn.join(by_name, [*sc, "bn"]).select(key, "pos", "path", "ord", F.lit(3).alias("tier"))
    best = t12.unionByName(t3).groupBy(key, "pos").agg(F.min_by("path", F.struct("tier", "ord")).alias("path"))
    return best.groupBy(key, "path").agg(F.min("pos").alias("first_pos"))


def crash_lines(traces: DataFrame, key: str = "trace_id") -> DataFrame:
    """Base name -> line number, the last mention wins."""
    fr = trace_frames(traces, key)
    return fr.groupBy(key, F.element_at(F.split("clean", "/"), -1).alias("bn")).agg(F.max_by("line", "pos").alias("crash_line"))


def priority_files(traces: DataFrame, files: DataFrame, key: str = "trace_id", scope=None) -> DataFrame:
    """J9 + J10: detected files with their crash line hint (if any)."""
    hits = stack_trace_files(traces, files, key, scope)
    lines = crash_lines(traces.select(key, "text"), key)
    return hits.join(lines, [hits[key] == lines[key], P.basename(hits["path"]) == lines["bn"]], "left").select(
        hits[key], hits["path"], "first_pos", "crash_line"
    )


# ---------------------------------------------------------------- J11 / J16

def query_terms(queries: DataFrame, scope: str = "project") -> DataFrame:
    """Distinct lower-cased terms of more than 3 characters: (query_id, scope, term)."""
    words = F.split(F.lower("text"), SPACE_RX)
    terms = F.array_distinct(F.filter(words, lambda t: F.length(t) >= MIN_TERM_CHARS))
    return queries.select("query_id", scope, F.explode(terms).alias("term"))


def name_hits(queries: DataFrame, files: DataFrame, scope: str = "project", fold: bool = True) -> DataFrame:
    """(query_id, scope, path, ord, tokens, full): files whose base name occurs in the query of
    their project; ``full`` if the whole path does. ``fold``: without regard to case.

    A name that occurs shares its first characters with the query at some place, so files
    meet only the queries that hold these characters.
    """
    low = F.lower if fold else (lambda c: F.col(c) if isinstance(c, str) else c)
    q = queries.select("query_id", scope, low("text").alias("q"))
    name = low(P.basename("path"))
    # names shorter than a gram are rare: their lengths are looked up only where there are any
    short = files.select(F.length(P.basename("path")).alias("n")).where((F.col("n") > 0) & (F.col("n") < GRAM)).distinct()
    size = F.length("q")

    def pieces(n: int) -> F.Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr("q", i, F.lit(n)))
        return F.when(size >= n, every).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[pieces(n) for n in [*sorted(r["n"] for r in short.collect()), GRAM]]))
    by_gram = q.select("query_id", scope, F.explode(F.array_distinct(grams)).alias("gram"))
    tokens = X.tokens("content") if "content" in files.columns else F.lit(None).cast("long")
    f = files.select(scope, "path", "ord", tokens.alias("tokens"), name.alias("name"), F.substring(name, 1, GRAM).alias("gram")).where(F.length("name") > 0)
    near = f.join(small(by_gram), [scope, "gram"]).drop("gram")
    hit = near.join(small(q), ["query_id", scope]).where(F.col("q").contains(F.col("name")))
    return hit.select("query_id", scope, "path", "ord", "tokens", F.col("q").contains(low("path")).alias("full"))


def term_hits(terms: DataFrame, files: DataFrame, scope: str = "project") -> DataFrame:
    """(scope, path, ord, tokens, term): the terms of a file's project that its content holds
    (substring test), by the terms' rarest grams in a scan of the project's files."""
    mine = files.join(small(terms.select(scope).distinct()), scope, "left_semi")
    keys = [scope, "path", "ord", "tokens"]
    texts = mine.select(scope, "path", "ord", X.tokens("content").alias("tokens"), F.lower("content").alias("text"), F.col(scope).alias("scope"))
    found = occurrences(texts, terms.select(F.col("term").alias("string"), F.col(scope).alias("scope")), keys, scoped=True)
    return found.withColumnRenamed("string", "term")


def relevance(queries: DataFrame, files: DataFrame, scope: str = "project") -> DataFrame:
    """The files of a query's project that score: +50 path named in the query, else +30
    base name named; +1 per distinct query term (> 3 chars) contained in the content
    (substring test, as the reference does). Files without a row score 0."""
    terms = query_terms(queries, scope)
    by_term = term_hits(terms, files, scope).join(small(terms), [scope, "term"])
    by_term = by_term.select("query_id", scope, "path", "ord", "tokens", F.lit(1).cast("long").alias("points"))
    points = F.when(F.col("full"), FULL_PATH_SCORE).otherwise(BASENAME_SCORE).cast("long")
    by_name = name_hits(queries, files, scope).select("query_id", scope, "path", "ord", "tokens", points.alias("points"))
    return by_term.unionByName(by_name).groupBy("query_id", scope, "path", "ord").agg(
        F.max("tokens").alias("tokens"), F.sum("points").alias("score"))


def mentioned_files(queries: DataFrame, files: DataFrame, scope: str = "project", limit: int = MENTION_LIMIT) -> DataFrame:
    """Files whose path or base name occurs in the query (first 3 in file
    order); when none, the first 3 files of the project."""
    q = queries.select("query_id", scope)
    w = Window.partitionBy("query_id").orderBy("ord")
    first_hits = name_hits(queries, files.select(scope, "path", "ord"), scope, fold=False).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= limit)
    wf = Window.partitionBy(scope).orderBy("ord")
    first_files = files.select(scope, "path", "ord").withColumn("rk", F.row_number().over(wf)).where(F.col("rk") <= limit)
    fallback = q.join(first_hits.select("query_id").distinct(), "query_id", "left_anti").join(first_files, scope)
    cols = ["query_id", scope, "path", F.col("rk").cast("long").alias("rank")]
    return first_hits.select(*cols).unionByName(fallback.select(*cols))


# ---------------------------------------------------------------- W1 / W2 / W5

def context_budget(max_tokens) -> F.Column:
    """Share of the model window given to the context."""
    c = F.col(max_tokens) if isinstance(max_tokens, str) else F.lit(max_tokens)
    return (c * F.lit(CONTEXT_SHARE)).cast("long")


def _persist(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _greedy(lists: DataFrame, scope: str) -> DataFrame:
    """lists(query_id, scope, remaining, pos, path, ord, score, cost): each query's bounded list
    taken in the order of pos, an item where its cost is below what remains. Gives
    (query_id, scope, left, taken items, items seen, the last one's score and ord)."""
    item = "struct<pos:bigint,score:bigint,ord:bigint,cost:bigint,path:string>"
    grp = lists.groupBy("query_id", scope, "remaining").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "score", "ord", "cost", "path"))).alias("items"))
    start = F.struct(F.col("remaining").alias("rem"), F.array().cast(f"array<{item}>").alias("acc"))
    grp = grp.withColumn("f", F.aggregate("items", start, lambda a, x: F.when(
        x["cost"] < a["rem"], F.struct((a["rem"] - x["cost"]).alias("rem"), F.array_append(a["acc"], x).alias("acc"))).otherwise(a)))
    last = F.element_at("items", -1)
    return grp.select("query_id", scope, F.col("f.rem").alias("left"), F.col("f.acc").alias("acc"), F.size("items").alias("seen"), last["score"].alias("c_score"), last["ord"].alias("c_ord"))


def _taken(folded: DataFrame, scope: str) -> DataFrame:
    return folded.select("query_id", scope, F.explode("acc").alias("x")).select("query_id", scope, "x.path", "x.ord", "x.score", "x.cost")


def _list_length(remaining) -> F.Column:
    """No more items than this can be taken: every cost is at least the header's."""
    return F.ceil(remaining / HEADER_TOKENS)


def pack_context(queries: DataFrame, files: DataFrame, max_tokens: int = 100000, diffs: DataFrame | None = None,
                 time_travel: bool = False, scope: str = "project") -> DataFrame:
    """W1 (W2 with ``diffs``): greedy skip packing of files into a token budget.

    Per query: base = tree header tokens (+20 in time-travel mode); stack-trace
    files found in the query are charged first (tokens + 20 each, even past the
    budget); the rest, by score desc then file order, are taken when
    ``cost < remaining`` and skipped otherwise. Output: one row per packed file
    with kind 'priority' or 'scored'.
    """
    q = queries.select("query_id", scope, "text")
    tree = tree_length(files, scope).select(scope, F.expr(f"({len(TREE_HEADER)} + tree_chars + 2) DIV 4").alias("base_tokens"))
    toks = files.select(scope, "path", X.tokens("content").alias("tokens"), "ord")
    cost = F.col("tokens") + HEADER_TOKENS
    extra = None
    if diffs is not None:
        extra = diffs.where(F.length("diff") > 0).select(scope, "path", (X.tokens("diff") + DIFF_EXTRA_TOKENS).alias("diff_tokens"))

    def costed(df: DataFrame) -> DataFrame:
        if extra is None:
            return df.withColumn("cost", cost.cast("long"))
        return df.join(extra, [scope, "path"], "left").withColumn("cost", (cost + F.coalesce("diff_tokens", F.lit(0))).cast("long")).drop("diff_tokens")

    frames = priority_files(q.withColumnRenamed("query_id", "trace_id"), files, "trace_id", scope).withColumnRenamed("trace_id", "query_id")
    frames = _persist(frames.join(q.select("query_id", scope), "query_id"))
    prio = toks.join(small(frames), [scope, "path"]).select(
        "query_id", scope, "path", "ord", "tokens", "first_pos", "crash_line", cost.alias("cost"))
    prio = _persist(prio)
    spent = prio.groupBy("query_id").agg(F.sum("cost").alias("spent"))
    start = q.join(tree, scope, "left").join(spent, "query_id", "left").select("query_id", scope, (
        F.lit(max_tokens) - F.coalesce("base_tokens", F.lit(0)) - (TIME_TRAVEL_TOKENS if time_travel else 0) - F.coalesce("spent", F.lit(0))).alias("remaining"))
    start = _persist(start.where(F.col("remaining") > 0))
    # a query whose tree and frames fill the budget takes no scored file: the others alone are scored, and as every
    # file of a scope costs tokens of its tree, the files that such a query can meet are bounded by the budget
    open_q = q.join(small(start.select("query_id").distinct()), "query_id", "left_semi")
    cand = relevance(open_q, files, scope).join(prio.select("query_id", "path"), ["query_id", "path"], "left_anti")
    cand = _persist(costed(cand).select("query_id", scope, "path", "ord", "score", "cost"))

    accepted = []
    # the scored files of each query
    state = start.select("query_id", "remaining", F.lit(None).cast("long").alias("c_score"), F.lit(None).cast("long").alias("c_ord"))
    while not state.isEmpty():
        after = (F.col("c_score").isNull() | (F.col("score") < F.col("c_score"))
                 | ((F.col("score") == F.col("c_score")) & (F.col("ord") > F.col("c_ord"))))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ord"))
        top = cand.join(small(state), "query_id").where(after & (F.col("cost") < F.col("remaining")))
        most = int(-(-(state.agg(F.max("remaining")).first()[0]) // HEADER_TOKENS))
        top = top.withColumn("pos", F.row_number().over(w)).where((F.col("pos") <= most) & (F.col("pos") <= _list_length(F.col("remaining"))))
        folded = _persist(_greedy(top, scope).join(state.select("query_id", "remaining"), "query_id"))
        accepted.append(_taken(folded, scope))
        state = folded.where((F.col("seen") >= _list_length(F.col("remaining"))) & (F.col("left") > HEADER_TOKENS)).select(
            "query_id", F.col("left").alias("remaining"), "c_score", "c_ord")
    used = accepted[0] if accepted else cand.limit(0)
    for a in accepted[1:]:
        used = used.unionByName(a)
    used = used.groupBy("query_id").agg(F.sum("cost").alias("used"))
    # the files that score nothing: one list per project in file order, read from a cursor
    left = F.col("remaining") - F.coalesce("used", F.lit(0))
    state = _persist(start.join(used, "query_id", "left").select("query_id", scope, left.alias("remaining"), F.lit(None).cast("long").alias("c_ord")).where(F.col("remaining") > HEADER_TOKENS))
    every = costed(toks).select(scope, "path", "ord", "cost")
    passed = cand.select("query_id", "path").unionByName(prio.select("query_id", "path"))
    while not state.isEmpty():
        per = state.groupBy(scope).agg(F.min(F.coalesce("c_ord", F.lit(-(1 << 62)))).alias("from_ord"), F.max("remaining").alias("most"))
        w = Window.partitionBy(scope).orderBy("ord")
        shared = every.join(small(per), scope).where((F.col("ord") > F.col("from_ord")) & (F.col("cost") < F.col("most")))
        n_list = int(-(-(state.agg(F.max("remaining")).first()[0]) // HEADER_TOKENS))
        shared = _persist(shared.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n_list).drop("from_ord", "most"))
        ends = shared.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("end"))
        open_ = state.join(shared, scope).where(F.col("c_ord").isNull() | (F.col("ord") > F.col("c_ord"))).join(passed, ["query_id", "path"], "left_anti")
        folded = _persist(_greedy(open_.withColumn("score", F.lit(0).cast("long")), scope))
        accepted.append(_taken(folded, scope))
        rest = state.select("query_id", scope, "remaining").join(folded.select("query_id", "left"), "query_id", "left").join(ends, scope)
        rest = rest.where(F.col("n") >= n_list).select("query_id", scope, F.coalesce("left", "remaining").alias("remaining"), F.col("end").alias("c_ord"))
        state = _persist(rest.where(F.col("remaining") > HEADER_TOKENS))
    scored = accepted[0] if accepted else cand.limit(0)
    for a in accepted[1:]:
        scored = scored.unionByName(a)
    pr = prio.select("query_id", scope, "path", "ord", F.lit(None).cast("long").alias("score"), "cost",
                     F.lit("priority").alias("kind"), "crash_line", "first_pos")
    sc = scored.select("query_id", scope, "path", "ord", "score", "cost", F.lit("scored").alias("kind"), F.lit(None).cast("long").alias("crash_line"), F.lit(None).cast("long").alias("first_pos"))
    return pr.unionByName(sc)


# Fixed texts of the context document.
TIME_TRAVEL_NOTE = "!!! TIME TRAVEL MODE ACTIVE !!!\nYou are analyzing REGRESSIONS. Focus on the DIFFS below.\n\n"
PRIORITY_NOTE = "--- ACTIVE DEBUGGING CONTEXT (PRIORITY) ---\n!!! THE USER IS DEBUGGING A CRASH !!!\n\n"


def context_blocks(packed: DataFrame, files: DataFrame, diffs: DataFrame | None = None, scope: str = "project") -> DataFrame:
    """X14 as rows (query_id, sec, pos, ord, text): priority files in the order of their frames with
    crash hints, then scored files by score and file order, with their diff if there is one."""
    j = packed.join(files.select(scope, "path", "content"), [scope, "path"])
    diff = F.lit("")
    if diffs is not None:
        j = j.join(diffs.where(F.length("diff") > 0).select(scope, "path", "diff"), [scope, "path"], "left")
        diff = F.when((F.col("kind") == "scored") & F.col("diff").isNotNull(), F.concat(F.lit("=== DIFF DETECTED: "), "path", F.lit(" ===\n"), "diff", F.lit("\n\n"))).otherwise(F.lit(""))
    hint = F.when(F.col("crash_line").isNotNull(), F.concat(F.lit("!!! CRASH DETECTED IN "), "path", F.lit(" AT LINE "), F.col("crash_line").cast("string"), F.lit(" !!!\n"))).otherwise(F.lit(""))
    text = F.concat(hint, diff, F.lit("=== FILE: "), "path", F.lit(" ===\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    first = F.col("kind") == "priority"
    return j.select("query_id", F.when(first, 1).otherwise(2).alias("sec"), F.when(first, F.col("first_pos")).otherwise(-F.col("score")).alias("pos"), "ord", text.alias("text"))


def context_document(packed: DataFrame, files: DataFrame, queries: DataFrame, diffs: DataFrame | None = None,
                     time_travel: bool = False, scope: str = "project", whole: bool = False) -> DataFrame:
    """X14 as ordered rows (query_id, scope, section, position, text, start_chars, chars).

    Sections: 0 the tree, 1 notes, 2 priority files, 3 scored files. With ``whole`` the texts of a query, in the order
    of section and position, are its document: section 0 is the header, blocks of ``TREE_BLOCK`` tree lines, and the
    line feeds that end it. Blocks are made once per scope and joined to the queries by (scope, block), so neither a
    tree nor a document is ever one string and no scope meets all its queries in one task. Without it section 0 is the
    header's row alone, which refers to the lines of ``operators.tree.tree_rows`` by the scope, and its ``chars`` counts
    header, tree and the blank line after it. What a query's window holds is its packed files, bounded by frames and
    token budget."""
    q = queries.select("query_id", scope)
    tree = tree_length(files, scope)
    head = q.join(tree, scope, "left").select(
        "query_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("position"), F.lit(TREE_HEADER).alias("text"),
        (F.lit(len(TREE_HEADER) + 2) + F.coalesce("tree_chars", F.lit(0))).alias("chars"))
    blocks = context_blocks(packed, files, diffs, scope)
    order = Window.partitionBy("query_id", "sec").orderBy("pos", "ord")
    body = blocks.select("query_id", (F.col("sec") + 1).alias("section"), (F.row_number().over(order) - 1).cast("long").alias("position"), "text")

    def note(of: DataFrame, position: int, text: str) -> DataFrame:
        return of.select("query_id", F.lit(1).alias("section"), F.lit(position).cast("long").alias("position"), F.lit(text).alias("text"))

    body = body.unionByName(note(packed.where(F.col("kind") == "priority").select("query_id").distinct(), 1, PRIORITY_NOTE))
    if time_travel:
        body = body.unionByName(note(q, 0, TIME_TRAVEL_NOTE))
    # the first row counts the whole tree, whose rows stay out of the window
    rows = head.unionByName(body.withColumn("chars", F.length("text").cast("long")))
    before = Window.partitionBy("query_id").orderBy("section", "position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_chars", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    rows = rows.join(q, "query_id").select("query_id", scope, "section", "position", "text", "start_chars", "chars")
    if not whole:
        return rows
    own = F.when(F.col("section") == 0, len(TREE_HEADER)).otherwise(F.col("chars")).cast("long")
    return rows.withColumn("chars", own).unionByName(_tree_parts(q, files, scope))


def _tree_parts(q: DataFrame, files: DataFrame, scope: str) -> DataFrame:
    """The rows of section 0 behind the header: blocks of tree lines, then the end of the section."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"])
    blocks = tree_rows(files, scope).groupBy(scope, F.expr(f"position DIV {TREE_BLOCK}").alias("block")).agg(
        F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"), (F.min("start_chars") + len(TREE_HEADER)).cast("long").alias("start_chars"))
    blocks = stored(blocks, "tree-blocks")
    per = blocks.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("tree"))
    mine = q.join(small(per), scope, "left").select("query_id", scope, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tree", F.lit(0)).alias("tree"))
    asked = mine.where(F.col("n") > 0).select("query_id", scope, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    body = asked.join(small(blocks), [scope, "block"]).select(
        "query_id", scope, F.lit(0).alias("section"), (F.col("block") + 1).alias("position"), "text", "start_chars", F.length("text").cast("long").alias("chars"))
    end = F.when(F.col("n") > 0, "\n").otherwise("\n\n")
    ends = mine.select("query_id", scope, F.lit(0).alias("section"), (F.col("n") + 1).alias("position"), end.alias("text"),
                       (F.col("tree") + len(TREE_HEADER)).cast("long").alias("start_chars"), F.length(end).cast("long").alias("chars"))
    return body.unionByName(ends)
