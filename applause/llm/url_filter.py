"""URL filtering against dated lists, as of the time each page was fetched.

Dated entries (``pattern, action, at``) become validity intervals. A capture is expanded into the few patterns that
could name it (its host and parent domains, the host with each leading part of the path) and joined by equality on
the pattern and the month, so a hot host is spread over months and no list is ever compared with every URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without ``www.``; null where the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.|\.$", "")
    return F.when(host != "", host)


def patterns(url: Column, path_parts: int = 3) -> Column:
    """All patterns that name a URL: ``a.b.c``, ``b.c``, ``c`` and ``a.b.c/x``, ``a.b.c/x/y``; null without a host.

    ``path_parts`` is the depth of the list's longest path pattern.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    depth = F.least(F.size(parts), F.lit(path_parts))
    prefixes = F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def spelt(pattern: Column) -> Column:
    """A listed pattern as ``patterns`` spells it: without scheme, user, port, ``www.`` and slashes too many; null without a host."""
    bare = F.regexp_replace(F.trim(pattern), r"(?i)^([a-z][a-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.|\.$", "")
    parts = F.filter(F.split(F.regexp_extract(bare, r"^[^/?#]*(/[^?#]*)", 1), "/"), lambda x: x != "")
    return F.when(host != "", F.array_join(F.concat(F.array(host), parts), "/"))


def depth_of(pattern: Column) -> Column:
    """Parts of the path of a pattern."""
    return F.size(F.filter(F.split(pattern, "/"), lambda x: x != "")) - 1


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, valid_from, valid_to``: when each pattern was listed; ``valid_to`` is open (null) for the last.

    ``entries`` has ``pattern, action`` (``add`` or ``remove``) and ``at``. Of several entries of a pattern at one time a
    removal counts. Repeated adds extend the interval; entries with a null in any column or without a host are left out.
    Patterns are hosts or hosts with leading parts of a path, spelt in any way that a URL may be.
    """
    clean = entries.select(spelt(F.col("pattern")).alias("pattern"), "action", "at").filter(
        "pattern is not null and at is not null and action in ('add', 'remove')"
    )
    states = clean.groupBy("pattern", "at").agg(F.min((F.col("action") == "add").cast("int")).alias("listed"))
    order = Window.partitionBy("pattern").orderBy("at")
    changed = states.withColumn("was", F.lag("listed", 1, 0).over(order)).filter("listed <> was")
    spans = changed.withColumn("valid_to", F.lead("at").over(order))
    return spans.filter("listed = 1").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def matches(captures: DataFrame, listed: DataFrame, url: str = "url", at: str = "fetched_at", key: str = "page_id",
            path_parts: int | None = None) -> DataFrame:
    """``page_id, mark, at, pattern``: every listed pattern that names a capture and was active at its fetch time.

    ``mark`` is a hash of the URL; with the id and the time it tells captures apart. Repeated captures give repeated rows.

    ``listed`` are intervals that do not overlap for one pattern. Intervals are cut by month, and so are captures; an
    open interval reaches the last capture. Captures without a host or a time match nothing. Without ``path_parts`` the
    depth of the paths comes from the list; a listed pattern deeper than a given one is an error.
    """
    if path_parts is None:
        path_parts = listed.agg(F.max(depth_of(F.col("pattern")))).first()[0] or 0  # one number
    else:
        deeper = F.raise_error(F.concat(F.lit(f"deeper than path_parts={path_parts}: "), F.col("pattern"))).cast("string")
        listed = listed.withColumn("pattern", F.when(depth_of(F.col("pattern")) > path_parts, deeper).otherwise(F.col("pattern")))
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    wanted = captures.select(
        F.col(key).alias("page_id"), F.xxhash64(url).alias("mark"), F.col(at).alias("_at"),
        F.explode(patterns(F.col(url), path_parts)).alias("pattern"),
    ).filter("_at is not null").withColumn("_month", month(F.col("_at")))
    last = captures.agg(F.max(month(F.col(at)))).first()[0] or 0  # one number
    until = F.least(F.coalesce(month(F.col("valid_to")), F.lit(last)), F.lit(last))
    cut = listed.filter(month(F.col("valid_from")) <= until).select(
        "pattern", "valid_from", "valid_to", F.explode(F.sequence(month(F.col("valid_from")), until)).alias("_month")
    )
    active = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    return wanted.join(cut, ["pattern", "_month"]).filter(active).select("page_id", "mark", F.col("_at").alias("at"), "pattern")


def evaluate(captures: DataFrame, blocked: DataFrame, allowed: DataFrame | None = None, url: str = "url",
             at: str = "fetched_at", key: str = "page_id", path_parts: int | None = None) -> DataFrame:
    """One row per row of ``captures``: ``page_id, host, fetched_at, n_blocking, blocked_by, allowed_by, keep``.

    The longest active pattern decides (``blocked_by``, ``allowed_by``: the longest, then the first by name); an allow
    pattern at least as long as the longest block pattern lets a capture pass. A null URL or time, or a URL without a
    host, is named by no list and stays. Captures may share an id, or have none: each is judged by its own URL and time.
    ``path_parts`` as in ``matches``.
    """
    hits = matches(captures, intervals(blocked), url, at, key, path_parts).withColumn("_block", F.lit(True))
    if allowed is not None:
        hits = hits.unionByName(
            matches(captures, intervals(allowed), url, at, key, path_parts).withColumn("_block", F.lit(False))
        )
    rows = captures.select(
        F.col(key).alias("page_id"), F.xxhash64(url).alias("mark"), F.col(at).alias("at"), host_of(F.col(url)).alias("host"),
        F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("boolean").alias("_block"), F.lit(1).alias("_times"),
    )
    named = hits.select("page_id", "mark", "at", F.lit(None).cast("string").alias("host"), "pattern", "_block", F.lit(0).alias("_times"))

    def longest(of):
        return F.min(F.when(of, F.struct((-F.length("pattern")).alias("n"), F.col("pattern").alias("p"))))

    both = rows.unionByName(named).groupBy("page_id", "mark", "at").agg(
        F.max("host").alias("host"), F.sum("_times").alias("times"), F.count_if(F.col("_block")).alias("hits"),
        longest(F.col("_block")).alias("b"), longest(~F.col("_block")).alias("a"),
    )
    decided = both.select(
        "page_id", "host", F.col("at").alias("fetched_at"), F.expr("hits div times").alias("n_blocking"),
        F.col("b.p").alias("blocked_by"), F.col("a.p").alias("allowed_by"),
        (F.col("b").isNull() | (F.coalesce(F.col("a.n") <= F.col("b.n"), F.lit(False)))).alias("keep"), "times",
    )
    return decided.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")
