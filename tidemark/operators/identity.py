"""Who is who: a ladder of exact rules for incoming records, and identities under links that must and must not hold.

Names, hints and other blocking keys give candidates for a review, never a merge. Everything is joins by equality and
sums per key: no pairs of all records that share a key are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import dropped, stored

# The rules in their order.
EXACT, WIKI, FUZZY, NAME_BORN, CONTEXT, SAME_NAME, AMBIGUOUS, CONFLICT, CREATE = (
    "exact_source_external_id", "exact_wikidata", "fuzzy_or_alias_candidate_queue", "exact_normalized_name_dob_unique",
    "exact_normalized_name_opponent_event_date_unique", "same_normalized_name_queue", "ambiguous_identity_queue",
    "identity_conflict_queue", "create_canonical_for_new_external",
)


def _place(event_id: Column, event_date: Column) -> Column:
    """What is known of an event, as one key: its id, its date or both; null if neither."""
    some = F.concat_ws("|", F.coalesce(event_id.cast("string"), F.lit("")), F.coalesce(event_date.cast("string"), F.lit("")))
    return F.when(event_id.isNotNull() | event_date.isNotNull(), some)


def met_in(bouts: DataFrame, people: DataFrame) -> DataFrame:
    """(name, opponent, place, person): each side of each bout with two named people, under its event's id, its date and both."""
    named = lambda side: people.select(F.col("person").alias(side), F.col("name").alias(f"{side}_name"))
    both = bouts.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").join(named("a"), "a").join(named("b"), "b")
    nothing = F.lit(None)
    places = F.array(*[_place(i, d) for i, d in ((F.col("event_id"), F.col("event_date")), (F.col("event_id"), nothing), (nothing, F.col("event_date")))])
    sides = F.array(*[F.struct(F.col(f"{x}_name").alias("name"), F.col(f"{y}_name").alias("opponent"), F.col(x).alias("person")) for x, y in (("a", "b"), ("b", "a"))])
    return both.select(F.explode(sides).alias("s"), F.array_distinct(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("s.*", F.explode("p").alias("place"))


def resolve(incoming: DataFrame, people: DataFrame, links: DataFrame, bouts: DataFrame, create: bool = True) -> DataFrame:
    """source, external_id, kind (linked, queued or created), rule, reason and person of each incoming record.

    incoming: source, external_id, name (normalised), wikidata_id, born, opponent (normalised name), event_id,
    event_date, hinted (a nickname, another spelling or order of the name). people: person, name, born. links: source,
    external_id, person. bouts: event_id, event_date, a, b. The first rule that speaks decides: a known id (a conflict
    under another name), a Wikidata id (a conflict if it names several people, or if name and birth date name another
    one alone), a hint (queued), name and birth date, name with opponent and event, the name alone (queued). Else the
    record is new; records of one batch don't see each other. Empty external ids or names are left out.
    """
    rows = incoming.where("trim(external_id) <> '' AND trim(name) <> ''")
    known = links.join(people.select("person", F.col("name").alias("known_name")), "person", "left").select("source", "external_id", F.col("person").alias("known"), "known_name")
    wiki = links.where("source = 'wikidata'").groupBy(F.col("external_id").alias("wikidata_id")).agg(F.min("person").alias("wiki"), (F.min("person") != F.max("person")).alias("wiki_many"))
    names = people.groupBy("name").agg(F.count("*").alias("same_name"), F.count("born").alias("with_born"))
    births = people.where("born IS NOT NULL").groupBy("name", "born").agg(F.count("*").alias("same_born"), F.min("person").alias("by_born"))
    where = met_in(bouts, people).groupBy("name", "opponent", "place").agg(F.min("person").alias("by_context"), (F.min("person") != F.max("person")).alias("context_many"))
    j = rows.withColumn("place", _place(F.col("event_id"), F.col("event_date")))
    j = j.join(known, ["source", "external_id"], "left").join(wiki, "wikidata_id", "left").join(names, "name", "left").join(births, ["name", "born"], "left").join(where, ["name", "opponent", "place"], "left")
    alone = F.coalesce(F.col("same_born"), F.lit(0)) == 1
    found = F.col("same_born").isNotNull()

    def says(kind: str, rule: str, reason: str, person: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.lit(reason).alias("reason"), (F.lit(None).cast(people.schema["person"].dataType) if person is None else person).alias("person"))

    ladder = [
        (F.col("known").isNotNull() & ~F.col("known_name").eqNullSafe(F.col("name")), says("queued", CONFLICT, "duplicate_external_id")),
        (F.col("known").isNotNull(), says("linked", EXACT, "exact_source_external_id", F.col("known"))),
        (F.col("wiki_many"), says("queued", CONFLICT, "wikidata_conflict")),
        (F.col("wiki").isNotNull() & alone & (F.col("by_born") != F.col("wiki")), says("queued", CONFLICT, "wikidata_conflicts_with_name_dob")),
        (F.col("wiki").isNotNull(), says("linked", WIKI, "exact_wikidata", F.col("wiki"))),
        (F.coalesce("hinted", F.lit(False)), says("queued", FUZZY, "candidate_hints_forbid_auto_link")),
        (alone, says("linked", NAME_BORN, "name_dob", F.col("by_born"))),
        (found, says("queued", AMBIGUOUS, "name_dob_not_unique")),
        (F.col("born").isNotNull() & (F.col("with_born") > 0), says("queued", CONFLICT, "dob_conflict")),
        (F.col("context_many"), says("queued", AMBIGUOUS, "context_not_unique")),
        (F.col("by_context").isNotNull(), says("linked", CONTEXT, "name_context", F.col("by_context"))),
        (F.col("same_name") > 0, says("queued", SAME_NAME, "same_normalized_name_without_unique_key")),
    ]
    last = says("created", CREATE, "no_existing_person") if create else says("queued", AMBIGUOUS, "create_disabled")
    verdict = reduce(lambda rest, rung: F.when(rung[0], rung[1]).otherwise(rest), reversed(ladder), last)
    return j.select("source", "external_id", verdict.alias("v")).select("source", "external_id", "v.*")


def candidates(incoming: DataFrame, people: DataFrame, queued: DataFrame) -> DataFrame:
    """(source, external_id, person): for queued records the people of the same name, a row each, for the review."""
    waiting = incoming.join(queued.where("kind = 'queued'").select("source", "external_id"), ["source", "external_id"], "left_semi")
    return waiting.select("source", "external_id", "name").join(people.select("name", "person"), "name").select("source", "external_id", "person")


# ---- reviews ---------------------------------------------------------------------------------------------------------


def transitions(reviews: DataFrame) -> DataFrame:
    """The reviews ledger with `accepted`: whether each decision could be taken in the state that the one before left.

    reviews: review, version (1, 2, 3...), decision (approve, reject or reverse). A review starts pending; approve and
    reject need that, reverse needs one of them, and a decision of the state that is there already changes nothing and
    is accepted. After a refused decision the state stays; a review's few decisions are folded in order of version.
    """
    after = lambda s, d: (
        F.when((s == "pending") & (d == "approve"), "approved").when((s == "pending") & (d == "reject"), "rejected").when(s.isin("approved", "rejected") & (d == "reverse"), "reversed").otherwise(s)
    )
    same = lambda s, d: ((s == "approved") & (d == "approve")) | ((s == "rejected") & (d == "reject")) | ((s == "reversed") & (d == "reverse"))
    start = F.struct(F.lit("pending").alias("state"), F.array().cast("array<struct<version:long,accepted:boolean,state:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = after(a["state"], x["decision"])
        made = F.struct(x["version"].cast("long").alias("version"), ((new != a["state"]) | same(a["state"], x["decision"])).alias("accepted"), new.alias("state"))
        return F.struct(new.alias("state"), F.concat(a["out"], F.array(made)).alias("out"))

    folded = reviews.groupBy("review").agg(F.array_sort(F.collect_list(F.struct("version", "decision"))).alias("d")).select("review", F.inline(F.aggregate("d", start, step, lambda a: a["out"])))
    return reviews.join(folded, ["review", "version"])


def in_force(reviews: DataFrame) -> DataFrame:
    """(review, state): the state after each review's last version. A reversed review binds nobody, so a merge that it made splits again."""
    done = transitions(reviews)
    return done.groupBy("review").agg(F.max_by("state", "version").alias("state"))


# ---- identities ------------------------------------------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable. nodes: node (long); edges: a, b.

    Each round every node takes the smallest label among its neighbours and itself, and then the label of that label, so
    the rounds grow with the logarithm of a chain's length, not with its length. States are tables in the shared folder.
    """
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = stored(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(seen, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # Whoever bore a label follows it: the label's own node may know a smaller one.
        hooks = least.groupBy(F.col("was").alias("of")).agg(F.min("label").alias("hook"))
        new = least.join(hooks, least["was"] == hooks["of"], "left").select("node", "was", F.least("label", F.coalesce("hook", "label")).alias("label"))
        new = stored(new, "labels")
        moved = new.where("label <> was").limit(1).count()
        dropped(labels)
        labels = new.select("node", "label")
        if not moved:
            dropped(both)
            return labels.withColumnRenamed("label", "component")


def identities(records: DataFrame, keys: DataFrame, must: DataFrame, cannot: DataFrame) -> DataFrame:
    """record, component, state (single, merged or conflict), identity and reason of each record.

    records: record (long, not negative), born; keys: record, key (string; records that share one are linked through
    it); must, cannot: a, b (records). Links of a component hold for all of it or for nobody: if two of its members
    must not be one, or have different birth dates, every member stays by itself and the component is a conflict for
    the review. Records named only in links are left out.
    """
    number = -1 - F.pmod(F.xxhash64(F.lit("key"), F.col("key")), F.lit(1 << 62))  # keys are nodes of their own, below all records
    held = keys.where("key IS NOT NULL").join(records.select("record"), "record", "left_semi")
    spokes = held.select(F.col("record").alias("a"), number.alias("b"))
    own = records.select(F.col("record").alias("node"))
    ties = must.join(own.select(F.col("node").alias("a")), "a", "left_semi").join(own.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    found = components(own.union(spokes.select("b").distinct()), spokes.union(ties)).where("node >= 0")
    # A component is named by its smallest record, as a key may be its smallest node.
    of = found.join(found.groupBy("component").agg(F.min("node").alias("name"), F.count("*").alias("size")), "component").select(F.col("node").alias("record"), F.col("name").alias("component"), "size")
    of = stored(of, "components")
    side = lambda x: of.select(F.col("record").alias(x), F.col("component").alias(f"{x}_of"))
    torn = cannot.join(side("a"), "a").join(side("b"), "b").where("a <> b AND a_of = b_of").select(F.col("a_of").alias("component")).distinct().withColumn("torn", F.lit(True))
    aged = of.join(records.select("record", "born"), "record").groupBy("component").agg((F.min("born") != F.max("born")).alias("aged"))
    j = of.join(aged, "component").join(torn, "component", "left")
    reason = F.when(F.col("torn"), "must_not_be_one").when(F.col("aged"), "dob_conflict")
    state = F.when(F.col("size") == 1, "single").when(reason.isNotNull(), "conflict").otherwise("merged")
    return j.select("record", "component", state.alias("state"), F.when(state == "merged", F.col("component")).otherwise(F.col("record")).alias("identity"), F.when(state == "conflict", reason).alias("reason"))
