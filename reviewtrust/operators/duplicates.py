"""Near-duplicate reviews: linked texts, exact similarity, clusters and their summary.

Copies of one text (the same words) are one class, named by its lowest review id: however many copies there are, they
cost one aggregate and one join, and only the class takes part in the search for similar texts.

What travels is one 64-bit hash a word; the sets of word pairs, triples and content words are made where they are compared.
A product of few texts (``FEW_TEXTS``, ``FEW_WORDS``) is compared text by text, at most ``FEW_TEXTS`` / 2 pairs a text: its words are
shuffled once (see ``operators.compare``). All other products, however large, take the way below.

Similar texts are found by an exact prefix join. Two sets that overlap by a share t must meet in the first n - ceil(t n) + 1
elements of each under any one order of elements; the order puts frequent ones last, by counts of ``ORDER_BUCKETS`` hash buckets
that every task holds, so a review's prefix is cut where the review is read and only prefixes are shuffled, once. A pair
goes on only if its sizes and the places of the common element still allow t. No element is skipped for being frequent, and
no list of holders is collected.

Clusters need no list of all links (``family_clusters``): the holders of an element are first checked against one of them, and
after that only pairs that still lie in different components are made, so a family of near copies costs rows in
proportion to its members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.text import (
    composite,
    content_of_hashes,
    dice_from,
    hashed_shingles,
    hashed_words,
    jaccard_from,
    tokens,
)
from reviewtrust.operators.compare import LINKS, links_in_product
from reviewtrust.operators.components import connected_components

KEY = ["product_id", "review_id"]
#: Where a review's peak similarity weighs in full.
SURE = 0.8


#: A product with at most so many reviews and words is compared text by text, all others by shared elements.
FEW_TEXTS = 256
FEW_WORDS = 1_000_000


def review_sets(reviews: DataFrame, keep: tuple[str, ...] = (), words: str | None = None) -> DataFrame:
    """Hashed words of each review, from which ``with_sets`` makes its sets; ``copy_key`` is null without words.

    ``words`` names the column that holds a review's tokens already.
    """
    words = reviews.select(*KEY, *keep, (F.col(words) if words else tokens(F.col("text"))).alias("w"))
    return words.select(
        *KEY,
        *keep,
        hashed_words(F.col("w")).alias("words"),
        F.when(F.size("w") > 0, F.sha2(F.array_join("w", " "), 256)).alias("copy_key"),
    )


def with_sets(sets: DataFrame) -> DataFrame:
    """Word pairs, triples and content words in place of ``words``."""
    words = F.col("words")
    return sets.select(
        *(c for c in sets.columns if c != "words"),
        hashed_shingles(words, 2).alias("pairs"),
        hashed_shingles(words, 3).alias("triples"),
        content_of_hashes(words).alias("content"),
    )


def copy_classes(sets: DataFrame) -> DataFrame:
    """product_id, review_id and ``first_id``, the lowest review with the same words, of all reviews with words."""
    keyed = sets.select(*KEY, "copy_key").where(F.col("copy_key").isNotNull())
    first = keyed.groupBy("product_id", "copy_key").agg(F.min("review_id").alias("first_id"))
    return keyed.join(first, ["product_id", "copy_key"]).select(*KEY, "first_id")


def _overlaps(threshold: float) -> dict[str, float]:
    """The Jaccard overlap that each set alone needs to lift the composite to ``threshold``."""
    dice = threshold / 0.75
    return {"triples": threshold, "pairs": threshold / 0.85, "content": dice / (2 - dice)}


#: Buckets by which elements are ordered: one short list of counts, whatever the input.
ORDER_BUCKETS = 1 << 16
_HOLDER = ["review_id", "n", "place"]


def _kinds(threshold: float) -> dict[str, float]:
    return {k: t - 1e-9 for k, t in _overlaps(threshold).items()}


def element_weights(sets: DataFrame) -> Column:
    """How often the elements of each bucket occur, as a literal array: ``ORDER_BUCKETS`` numbers come to the driver."""
    elements = sets.select(F.explode_outer(F.concat(*_overlaps(0.5))).alias("e")).where(F.col("e").isNotNull())
    counted = elements.groupBy(F.pmod("e", F.lit(ORDER_BUCKETS)).alias("bucket")).agg(F.count("*").alias("n")).collect()
    counts = {r["bucket"]: r["n"] for r in counted}
    return F.split(F.lit(",".join(str(counts.get(k, 0)) for k in range(ORDER_BUCKETS))), ",").cast("array<bigint>")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(kind, product_id, element, review_id, n, place): the first elements of each set, the least frequent buckets first."""
    weights = element_weights(sets)

    def cut(kind: str, t: float) -> Column:
        keyed = F.transform(kind, lambda e: F.struct(F.get(weights, F.pmod(e, F.lit(ORDER_BUCKETS)).cast("int")).alias("w"), e.alias("e")))
        first = F.slice(F.array_sort(keyed), F.lit(1), (F.size(kind) - F.ceil(F.lit(t) * F.size(kind)) + 1).cast("int"))
        taken = F.when(F.size(kind) > 0, F.transform(first, lambda x: x["e"])).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.lit(kind).alias("kind"), F.size(kind).alias("n"), taken.alias("elements"))

    each = F.explode(F.array(*(cut(k, t) for k, t in _kinds(threshold).items())))
    held = sets.select(*KEY, each.alias("s")).select(*KEY, "s.*")
    # posexplode_outer: a plain explode makes the optimizer push a "not empty" filter down to the scan.
    rows = held.select(*KEY, "kind", "n", F.posexplode_outer("elements").alias("at", "element")).where("element is not null")
    return rows.select("kind", "product_id", "element", "review_id", "n", (F.col("at") + 1).alias("place"))


_ELEMENT = ["kind", "product_id", "element"]


def _possible(threshold: float) -> Column:
    """Do sizes and places of a common element still allow the overlap its kind needs? For columns l_n, l_place, r_n, r_place."""
    t = F.create_map(*(x for k, v in _kinds(threshold).items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    rest = F.least(F.col("l_n") - F.col("l_place"), F.col("r_n") - F.col("r_place")) + 1
    return (F.least("l_n", "r_n") >= t * F.greatest("l_n", "r_n")) & (rest >= t / (t + 1) * (F.col("l_n") + F.col("r_n")))


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select(*_ELEMENT, *(F.col(c).alias(f"{side}_{c}") for c in (*_HOLDER, *more)))


def _in_order(rows: DataFrame) -> DataFrame:
    """Distinct pairs, the lower review on the left."""
    ids = ("l_review_id", "r_review_id")
    return rows.select("product_id", F.least(*ids).alias("left_id"), F.greatest(*ids).alias("right_id")).distinct()


def candidate_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Review pairs (left_id < right_id) among which are all that reach ``threshold`` (at most 0.75) in some set."""
    prefix = prefixes(sets, threshold)
    joined = _side(prefix, "l").join(_side(prefix, "r"), _ELEMENT)
    return _in_order(joined.where(F.col("l_review_id") < F.col("r_review_id")).where(_possible(threshold)))


def pair_similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact composite similarity of the candidate pairs that share a word pair."""
    left = sets.select(
        "product_id",
        F.col("review_id").alias("left_id"),
        F.col("pairs").alias("l2"),
        F.col("triples").alias("l3"),
        F.col("content").alias("lc"),
    )
    right = sets.select(
        "product_id",
        F.col("review_id").alias("right_id"),
        F.col("pairs").alias("r2"),
        F.col("triples").alias("r3"),
        F.col("content").alias("rc"),
    )
    joined = pairs.join(left, ["product_id", "left_id"]).join(right, ["product_id", "right_id"])
    counted = joined.select(
        "product_id",
        "left_id",
        "right_id",
        *[
            F.size(F.array_intersect(f"l{k}", f"r{k}")).alias(f"shared{k}")
            for k in ("2", "3", "c")
        ],
        *[F.size(f"{side}{k}").alias(f"n{side}{k}") for side in "lr" for k in ("2", "3", "c")],
    )
    score = composite(
        jaccard_from(F.col("shared3"), F.col("nl3"), F.col("nr3")),
        jaccard_from(F.col("shared2"), F.col("nl2"), F.col("nr2")),
        dice_from(F.col("sharedc"), F.col("nlc"), F.col("nrc")),
    )
    return counted.where("shared2 > 0").select("product_id", "left_id", "right_id", score.alias("similarity"))


def _products_by_size(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The products compared text by text, and all others."""
    from reviewtrust.session import Workspace

    counted = sets.groupBy("product_id").agg(F.count("*").alias("texts"), F.sum(F.size("words")).alias("n_words"))
    few = (F.col("texts") <= FEW_TEXTS) & (F.col("n_words") <= FEW_WORDS)
    sized = Workspace(sets.sparkSession, "products").write(counted.select("product_id", few.alias("few")))
    return sized.where("few").select("product_id"), sized.where("not few").select("product_id")


def _links_of_few(sets: DataFrame, products: DataFrame, threshold: float) -> DataFrame:
    """Links between the different texts of small products, each named by its lowest review; words are shuffled once."""
    rows = sets.select(*KEY, "words").join(products, "product_id", "left_semi")
    return rows.groupBy("product_id").applyInArrow(links_in_product(threshold), LINKS)


def _first_texts(sets: DataFrame, classes: DataFrame) -> DataFrame:
    return sets.join(classes.where(F.col("review_id") == F.col("first_id")).select(*KEY), KEY, "left_semi")


def similar_texts(sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different texts, by their classes' ids, at or above the threshold; ``sets`` is best a written table."""
    few, many = _products_by_size(sets)
    links = _links_of_few(sets, few, threshold)
    if many.isEmpty():
        return links
    texts = with_sets(_first_texts(sets.join(many, "product_id", "left_semi"), classes))
    scored = pair_similarity(candidate_pairs(texts, threshold), texts)
    return links.unionByName(scored.where(F.col("similarity") >= threshold))


def _copy_links(classes: DataFrame) -> DataFrame:
    return classes.where(F.col("review_id") > F.col("first_id")).select(
        "product_id",
        F.col("first_id").alias("left_id"),
        F.col("review_id").alias("right_id"),
        F.lit(1.0).alias("similarity"),
    )


def _endpoints(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "product_id",
        "similarity",
        F.explode(
            F.array(
                F.struct(F.col("left_id").alias("review_id"), F.col("right_id").alias("other_id")),
                F.struct(F.col("right_id").alias("review_id"), F.col("left_id").alias("other_id")),
            )
        ).alias("e"),
    ).select("product_id", "e.review_id", "e.other_id", "similarity")


def exact_copy_links(reviews: DataFrame) -> DataFrame:
    """Link every copy of one text to its lowest id: one aggregate, no pairs in the group."""
    return _copy_links(copy_classes(review_sets(reviews)))


def _linked(reviews: DataFrame, settings: Settings, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Written tables: the classes of copies, and the links between different texts."""
    from reviewtrust.session import Workspace

    return _linked_sets(Workspace(reviews.sparkSession, "sets").write(review_sets(reviews)), settings, threshold)


def _linked_sets(sets: DataFrame, settings: Settings, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for a written table of ``review_sets``."""
    from reviewtrust.session import Workspace

    space = Workspace(sets.sparkSession, "similar")
    sets = sets.select(*KEY, "words", "copy_key")
    classes = space.write(copy_classes(sets))
    return classes, space.write(
        similar_texts(sets, classes, settings.duplicate_similarity if threshold is None else threshold)
    )


def text_links(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Links between different texts alone, each named by its lowest review."""
    return _linked(reviews, settings)[1]


def near_duplicate_edges(
    reviews: DataFrame, settings: Settings = DEFAULTS, threshold: float | None = None
) -> DataFrame:
    """Links at or above the duplicate threshold: between different texts (each named by its lowest review), and
    from every further copy of a text to that lowest review."""
    classes, links = _linked(reviews, settings, threshold)
    return links.unionByName(_copy_links(classes))


def clusters_from_edges(edges: DataFrame) -> DataFrame:
    """One row per clustered review: cluster_id (lowest member), cluster_size, max_similarity.

    A clustered review has a partner at or above the threshold, so its peak similarity
    over the edges is its peak over all candidates.
    """
    labels = connected_components(
        edges.select("product_id", F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    )
    sizes = labels.groupBy("product_id", "component").agg(F.count("*").alias("cluster_size"))
    peak = _endpoints(edges).groupBy(*KEY).agg(F.max("similarity").alias("max_similarity"))
    return (
        labels.join(sizes, ["product_id", "component"])
        .select(
            "product_id",
            F.col("node").alias("review_id"),
            F.col("component").alias("cluster_id"),
            "cluster_size",
        )
        .join(peak, KEY)
    )


def review_clusters(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Clusters of near-duplicate reviews, without the reviews that have no partner."""
    return clusters_from_edges(near_duplicate_edges(reviews, settings))


def review_clusters_of_sets(sets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The same for a written table of ``review_sets``."""
    classes, links = _linked_sets(sets, settings)
    return clusters_from_edges(links.unionByName(_copy_links(classes)))


def duplication_findings(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The full finding of every review. Peak similarity is over linked partners: 0 without any."""
    classes, links = _linked(reviews, settings)
    clusters = clusters_from_edges(links.unionByName(_copy_links(classes)))
    # A review's first partners are among the first members of the classes linked to its own, itself left out.
    shown = settings.similar_ids_shown
    in_class = Window.partitionBy("product_id", "first_id").orderBy("review_id")
    members = (
        classes.withColumn("rn", F.row_number().over(in_class))
        .where(F.col("rn") <= shown + 1)
        .select("product_id", F.col("first_id").alias("other_id"), F.col("review_id").alias("partner"))
    )
    own = classes.where(F.col("review_id") == F.col("first_id")).select(*KEY, F.col("first_id").alias("other_id"))
    around = _endpoints(links).select(*KEY, "other_id").unionByName(own)
    nearest = Window.partitionBy(*KEY).orderBy("partner")
    partners = (
        around.join(members, ["product_id", "other_id"])
        .withColumn("rn", F.row_number().over(nearest))
        .where(F.col("rn") <= shown + 1)
        .groupBy("product_id", F.col("review_id").alias("first_id"))
        .agg(F.sort_array(F.collect_list("partner")).alias("partners"))
    )
    similar = classes.join(partners, ["product_id", "first_id"]).select(
        *KEY,
        F.slice(F.filter("partners", lambda p: p != F.col("review_id")), 1, shown).alias("similar_to"),
    )
    return (
        reviews.select(*KEY)
        .join(similar, KEY, "left")
        .join(clusters, KEY, "left")
        .select(
            *KEY,
            F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"),
            F.coalesce("cluster_size", F.lit(1)).cast("bigint").alias("cluster_size"),
            F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id"),
            F.coalesce("similar_to", F.array().cast("array<bigint>")).alias("similar_to"),
        )
    )


def family_clusters(reviews: DataFrame, settings: Settings = DEFAULTS, sure: float = SURE) -> DataFrame:
    """The clusters of ``review_clusters`` without a list of all links, see ``clusters_of_sets``."""
    from reviewtrust.session import Workspace

    return clusters_of_sets(Workspace(reviews.sparkSession, "sets").write(review_sets(reviews)), settings, sure)


def clusters_of_sets(sets: DataFrame, settings: Settings = DEFAULTS, sure: float = SURE) -> DataFrame:
    """Clusters of a written table of ``review_sets``: of products of few texts from all links, of others by ``_families``."""
    from reviewtrust.session import Workspace

    space = Workspace(sets.sparkSession, "families")
    classes = space.write(copy_classes(sets))
    few, many = _products_by_size(sets)
    links = space.write(_links_of_few(sets, few, settings.duplicate_similarity))
    clusters = clusters_from_edges(links.unionByName(_copy_links(classes.join(few, "product_id", "left_semi"))))
    if many.isEmpty():
        return clusters
    rest = (df.join(many, "product_id", "left_semi") for df in (sets, classes))
    return clusters.unionByName(_families(*rest, settings, sure).select(*clusters.columns))


def _families(sets: DataFrame, classes: DataFrame, settings: Settings, sure: float) -> DataFrame:
    """Clusters of large products.

    ``max_similarity`` is exact below ``sure``; from there on it is the similarity of some linked pair, ``sure`` or more. Three steps:

    1. stars: every holder of an element is compared with the element's lowest holder, one row a holder;
    2. bridges: of the pairs that share an element, those whose ends the stars left in different components;
    3. peaks: pairs inside a component, for members without a link of ``sure`` or more so far.

    A family whose members all resemble its lowest one by ``sure`` ends after the stars.
    """
    from reviewtrust.session import Workspace

    space, threshold = Workspace(sets.sparkSession, "families"), settings.duplicate_similarity
    texts = space.write(with_sets(_first_texts(sets.select(*KEY, "words"), classes)))
    prefix = space.write(prefixes(texts, threshold))

    def scored(pairs: DataFrame) -> DataFrame:
        return space.write(pair_similarity(_in_order(pairs.where(_possible(threshold))), texts).where(F.col("similarity") >= threshold))

    def components(links: DataFrame) -> DataFrame:
        found = connected_components(links.select("product_id", F.col("left_id").alias("a"), F.col("right_id").alias("b")))
        return found.select("product_id", F.col("node").alias("review_id"), "component")

    def labelled(named: DataFrame) -> DataFrame:
        return space.write(prefix.join(named, KEY, "left").withColumn("component", F.coalesce("component", "review_id")))

    lowest = prefix.groupBy(*_ELEMENT).agg(F.min(F.struct(*_HOLDER)).alias("low"), F.count("*").alias("holders"))
    low = lowest.where("holders > 1").select(*_ELEMENT, *(F.col(f"low.{c}").alias(f"r_{c}") for c in _HOLDER))
    stars = scored(_side(prefix, "l").join(low, _ELEMENT).where("l_review_id <> r_review_id"))

    named = space.write(components(stars))
    held = labelled(named)
    # Elements of one component alone, as most of a family's are, make no bridge.
    split = held.groupBy(*_ELEMENT).agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one < other")
    open_ = held.join(split.select(*_ELEMENT), _ELEMENT, "left_semi")
    across = _side(open_, "l", "component").join(_side(open_, "r", "component"), _ELEMENT).where("l_component < r_component")
    bridges = scored(across)
    links = stars
    if not bridges.isEmpty():
        links = stars.unionByName(bridges)
        named = space.write(components(links))
        held = labelled(named)

    best = _endpoints(links).groupBy(*KEY).agg(F.max("similarity").alias("best"))
    unsure = held.join(best.where(F.col("best") < sure).select(*KEY), KEY, "left_semi")
    around = _side(unsure, "l", "component").join(_side(held, "r", "component"), _ELEMENT)
    peaks = scored(around.where("l_component = r_component and l_review_id <> r_review_id"))
    best = _endpoints(links.unionByName(peaks)).groupBy(*KEY).agg(F.max("similarity").alias("best"))

    # A class of copies is a member of its text's component; a copy's peak is the copy.
    first = ["product_id", "first_id"]
    facts = (
        classes.groupBy(*first).agg(F.count("*").alias("copies"))
        .join(named.withColumnRenamed("review_id", "first_id"), first, "left")
        .join(best.withColumnRenamed("review_id", "first_id"), first, "left")
        .withColumn("cluster_id", F.coalesce("component", "first_id"))
    )
    sizes = facts.groupBy("product_id", "cluster_id").agg(F.sum("copies").alias("cluster_size")).where("cluster_size > 1")
    known = facts.join(sizes, ["product_id", "cluster_id"]).select(
        *first, "cluster_id", "cluster_size", F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("max_similarity")
    )
    return classes.join(known, first).select(*KEY, "cluster_id", "cluster_size", "max_similarity")


def top_clusters(clusters: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The largest clusters per product (lowest id first among equals)."""
    sizes = clusters.select("product_id", "cluster_id", "cluster_size").distinct()
    by_size = Window.partitionBy("product_id").orderBy(F.desc("cluster_size"), "cluster_id")
    return sizes.withColumn("rank", F.row_number().over(by_size)).where(
        F.col("rank") <= settings.top_clusters
    )


def cluster_summary(
    reviews: DataFrame, clusters: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Size, first member ids and a sample text of the largest clusters per product."""
    top = top_clusters(clusters, settings)
    members = clusters.select(*KEY, "cluster_id").join(
        top.select("product_id", "cluster_id"), ["product_id", "cluster_id"], "left_semi"
    )
    in_order = Window.partitionBy("product_id", "cluster_id").orderBy("review_id")
    shown = (
        members.withColumn("rn", F.row_number().over(in_order))
        .where(F.col("rn") <= settings.cluster_ids_shown)
        .groupBy("product_id", "cluster_id")
        .agg(F.sort_array(F.collect_list("review_id")).alias("review_ids"))
    )
    sample = reviews.select(
        "product_id",
        F.col("review_id").alias("cluster_id"),
        F.left("text", F.lit(settings.cluster_sample_chars)).alias("sample"),
    )
    return (
        top.join(shown, ["product_id", "cluster_id"])
        .join(sample, ["product_id", "cluster_id"])
        .select("product_id", "rank", "cluster_id", "cluster_size", "review_ids", "sample")
    )
