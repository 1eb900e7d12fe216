"""Article graph: node and edge tables, co-occurrence, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch.functions.text import or_empty
from corpuswatch.session import dealt

NODE_COLUMNS, EDGE_COLUMNS = ["id", "label", "props"], ["src", "dst", "type", "weight", "props"]


def entity_key(kind: Column, name: Column) -> Column:
    return F.left(F.lower(F.concat_ws(":", F.coalesce(kind, F.lit("unknown")), or_empty(name))), F.lit(200))


def _props(**columns: Column) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])


def _entity_rows(articles: DataFrame) -> DataFrame:
    rows = articles.select(
        "content_hash", "published_at", "crawled_at", "url", "sentiment_label", F.posexplode("entities").alias("pos", "e")
    )
    return rows.withColumn("key", entity_key(F.col("e.type"), F.col("e.name")))


def build_nodes(articles: DataFrame, mode: str = "intended") -> DataFrame:
    """Article, source, topic and entity nodes; the first write of a property wins.

    Counters are plain counts (``reference`` mode starts them at the second sighting). Every label is one
    grouped aggregate with small buffers, so popular nodes combine before the shuffle.
    """
    less = 1 if mode == "reference" else 0
    order = F.struct("crawled_at", "url")
    n = F.count(F.lit(1)) - less
    article = articles.groupBy(F.col("content_hash").alias("id")).agg(
        F.min_by(
            _props(
                url=F.col("url"), title=F.left("title", F.lit(500)), source=F.col("source"), source_type=F.col("source_type"),
                published_at=F.col("published_at"), sentiment_label=F.col("sentiment_label"),
                sentiment_score=F.col("sentiment_score"), region=or_empty(F.col("region")),
            ), order,
        ).alias("props")
    ).withColumn("label", F.lit("Article"))
    source = articles.groupBy(F.coalesce("source", F.lit("unknown")).alias("id")).agg(
        _props(source_type=F.min_by("source_type", order), article_count=n, last_seen=F.max("crawled_at")).alias("props")
    ).withColumn("label", F.lit("Source"))
    topic = articles.select(F.explode("categories").alias("id")).groupBy("id").agg(_props(mention_count=n).alias("props"))
    topic = topic.withColumn("label", F.lit("Topic"))
    first = F.struct("crawled_at", "url", "pos")
    entity = _entity_rows(articles).groupBy(F.col("key").alias("id")).agg(
        _props(name=F.min_by("e.name", first), type=F.min_by("e.type", first), mention_count=n).alias("props")
    ).withColumn("label", F.lit("Entity"))
    out = article.select(*NODE_COLUMNS)
    for part in (source, topic, entity):
        out = out.unionByName(part.select(*NODE_COLUMNS))
    return out


def build_edges(articles: DataFrame) -> DataFrame:
    """FROM_SOURCE, TAGGED_AS and MENTIONS edges, each once."""
    no_props = F.expr("cast(map() as map<string,string>)")
    source = articles.select(
        F.col("content_hash").alias("src"), F.coalesce("source", F.lit("unknown")).alias("dst"), F.lit("FROM_SOURCE").alias("type"),
        F.lit(None).cast("string").alias("mood"),
    )
    topic = articles.select(
        F.col("content_hash").alias("src"), F.explode("categories").alias("dst"), F.lit("TAGGED_AS").alias("type"),
        F.lit(None).cast("string").alias("mood"),
    )
    mention = _entity_rows(articles).select(
        F.col("content_hash").alias("src"), F.col("key").alias("dst"), F.lit("MENTIONS").alias("type"), F.col("sentiment_label").alias("mood")
    )
    edges = source.unionByName(topic).unionByName(mention).distinct()
    props = F.when(F.col("mood").isNotNull(), F.create_map(F.lit("sentiment"), F.col("mood"))).otherwise(no_props)
    return edges.select("src", "dst", "type", F.lit(1).cast("bigint").alias("weight"), props.alias("props"))


def list_pairs(items: Column) -> Column:
    """Pairs (src, dst) of every item with each later one of the same short list."""
    return F.flatten(
        F.transform(
            items,
            lambda x, i: F.transform(
                F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("src"), y.alias("dst"))
            ),
        )
    )


def entity_pairs(df: DataFrame, keys: str = "entity_keys", cap: int | None = None) -> DataFrame:
    """Directed pairs of the entity keys of each article, without a shuffle; ``cap``: only of its first keys (the analysed system takes five)."""
    listed = F.col(keys) if cap is None else F.slice(keys, 1, cap)
    return df.withColumn("_k", listed).select(F.inline(list_pairs(F.col("_k"))))


def category_pairs(df: DataFrame, categories: str = "categories") -> DataFrame:
    """Directed pairs of an article's categories (at most three are kept, so at most three pairs)."""
    return df.select(F.inline(list_pairs(F.col(categories))))


def n_pairs(lists: DataFrame, keys: str = "entity_keys") -> int:
    """How many pairs ``entity_pairs`` makes of lists, from their sizes."""
    size = F.size(keys).cast("long")
    return int(lists.agg(F.sum(F.when(size > 1, size * (size - 1) / 2))).first()[0] or 0)


def co_occurrence(pairs: DataFrame, edge_type: str, n: int | None = None) -> DataFrame:
    """Weighted edges from co-occurrence pairs; counts combine before the shuffle.

    With ``n``, the number of pairs, they are dealt by pair first, so that the counts that a task holds do not grow with the table: for pairs that
    hardly repeat within a task.
    """
    pairs = pairs if n is None else dealt(pairs, n, "src", "dst")
    counted = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return counted.withColumn("type", F.lit(edge_type))


def basket_lists(baskets: DataFrame, first: int | None = None) -> DataFrame:
    """Rows (article, pos, entity_key) to the entity keys per article in list order, or only its ``first`` ones."""
    rank = F.row_number().over(Window.partitionBy("article").orderBy("pos", "entity_key"))
    early = dealt(baskets, baskets.count(), "article").withColumn("_rank", rank)
    early = early if first is None else early.where(F.col("_rank") <= first)
    keys = F.array_sort(F.collect_list(F.struct("_rank", "entity_key")))
    return early.groupBy("article").agg(F.transform(keys, lambda x: x["entity_key"]).alias("entity_keys"))


def entity_connections(nodes: DataFrame, edges: DataFrame, name: str, k: int = 20) -> DataFrame:
    """Rows (name, type, weight): the other ends of the RELATES_TO edges of all entities of a name, in either direction, heaviest first.

    ``nodes`` as of ``build_nodes``. The few entities of the name pick their edges; only those edges meet the nodes again.
    """
    entities = nodes.where(F.col("label") == "Entity").select("id", F.col("props")["name"].alias("name"), F.col("props")["type"].alias("type"))
    named = entities.where(F.col("name") == name).select("id")
    related = edges.where(F.col("type") == "RELATES_TO").select("src", "dst", "weight")
    out = related.join(named, related["src"] == named["id"], "left_semi").select(F.col("dst").alias("id"), "weight")
    back = related.where("src <> dst").join(named, related["dst"] == named["id"], "left_semi").select(F.col("src").alias("id"), "weight")
    return out.unionByName(back).join(entities, "id").select("name", "type", "weight", "id").orderBy(F.col("weight").desc(), "name", "id").limit(k).drop("id")


def mention_pairs(mentions: DataFrame, article: str = "article", pos: str = "pos", key: str = "entity_key", cap: int | None = None) -> DataFrame:
    """Directed pairs (article, src, dst) of the mentions of each article in list order; ``cap``: only of its first ones (the analysed system: five).

    Mentions are rows and meet in a join by article, so the pairs of a long list are never one array in one row.
    """
    rank = F.row_number().over(Window.partitionBy(article).orderBy(pos, key))
    ranked = mentions.select(F.col(article).alias("article"), F.col(key).alias("_key"), rank.alias("_rank"))
    ranked = ranked if cap is None else ranked.where(F.col("_rank") <= cap)
    later = ranked.select(F.col("article"), F.col("_key").alias("dst"), F.col("_rank").alias("_after"))
    return ranked.join(later, "article").where("_rank < _after").select("article", F.col("_key").alias("src"), "dst")


def relates_to(articles: DataFrame, cap: int | None = None) -> DataFrame:
    """RELATES_TO edges with weights from the articles' own ``entities``, as ``build_nodes`` keys them."""
    mentions = articles.select(F.struct("content_hash", "url").alias("article"), F.posexplode("entities").alias("pos", "e"))
    keyed = mentions.select("article", "pos", entity_key(F.col("e.type"), F.col("e.name")).alias("entity_key"))
    return co_occurrence(mention_pairs(keyed, cap=cap), "RELATES_TO")


def latest_subgraph(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Edges at the newest articles, and the nodes at their ends."""
    articles = nodes.where(F.col("label") == "Article").select(F.col("id").alias("src"), F.col("props")["published_at"].alias("_at"))
    links = (
        edges.join(articles, "src").orderBy(F.col("_at").desc(), "src", "type", "dst").limit(limit).select("src", "dst", "type")
    )
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi"), links


def k_hop(edges: DataFrame, center: str | Column, depth: int = 2, limit: int | None = None) -> DataFrame:
    """Nodes within ``depth`` hops of a node in either direction, with their distance (columns ``id``, ``hops``).

    Each hop joins the frontier with the edge table and drops nodes already reached.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = center if isinstance(center, Column) else F.lit(center)
    first = both.where(F.col("src") == start).select(F.col("dst").alias("id")).where(F.col("id") != start).distinct()
    reached = first.withColumn("hops", F.lit(1))
    frontier = reached
    for hop in range(2, depth + 1):
        step = both.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        fresh = step.where(F.col("id") != start).distinct().join(reached.select("id"), "id", "left_anti")
        frontier = fresh.withColumn("hops", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached if limit is None else reached.orderBy("hops", "id").limit(limit)


def closed_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are in the node table."""
    ids = nodes.select("id")
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")


def filter_labels(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the given node labels."""
    kept = nodes.where(F.col("label").isin(labels))
    return kept, closed_links(edges, kept)
