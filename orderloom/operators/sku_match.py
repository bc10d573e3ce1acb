"""Resolve order lines to catalog rows through a cascade of layers.

Work is done on distinct (owner, name, unit) keys against catalog groups (owner, name, unit, specification): both
sides are collapsed before anything is joined, so copies of a line or of a catalog row cost one row each.
Input columns: lines have owner_code, product_name, unit; the catalog has owner_code, sku_code, customer_code,
sku_name, unit, unit_type, conversion_ratio, product_spec, status.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import similarity as sim
from ..functions import text as tx
from ..session import cut_lineage
from .blocking import containment_join, salted_join, similar_pairs
from .ranking import best_with_ties

KEY = ["owner_code", "name", "order_unit"]
SKU_FIELDS = ["sku_code", "sku_name", "unit", "unit_type", "conversion_ratio", "product_spec"]
GATE = ["owner_code", "gate"]
NO_GROUP = "*none*"
ANY_GROUP = "*any*"


# --- inputs --------------------------------------------------------------------------

def active_catalog(catalog: DataFrame, owner: str | None = None, status: str = "ACTIVE") -> DataFrame:
    """The seven matching columns of the active rows, of all owners unless one is named."""
    out = catalog.where(F.col("status") == status)
    if owner is not None:
        out = out.where(F.col("owner_code") == owner)
    return out.select("owner_code", *SKU_FIELDS, "customer_code")


def mapping_scan(catalog: DataFrame, owner: str | None = None, keyword: str | None = None, code: str | None = None) -> DataFrame:
    """Active rows by owner, by a word in the name, by exact SKU or customer code; name_length orders them."""
    out = catalog.where("status = 'ACTIVE'")
    if owner is not None:
        out = out.where(F.col("owner_code") == owner)
    if keyword is not None:
        out = out.where(F.col("sku_name").contains(keyword))
    if code is not None:
        out = out.where((F.col("sku_code") == code) | (F.col("customer_code") == code))
    return out.select("owner_code", "sku_code", "sku_name", F.length("sku_name").cast("bigint").alias("name_length"))


def raw_keys(lines: DataFrame) -> DataFrame:
    """Distinct (owner, name, unit) as written, with the scrubbed key. Text work runs on these, never on the lines."""
    raw = lines.select("owner_code", "product_name", "unit").distinct()
    return raw.withColumn("name", tx.scrub("product_name", all_zero_width=False)).withColumn(
        "order_unit", F.coalesce("unit", F.lit(fv.DEFAULT_UNIT)))


def keys_of(raw: DataFrame) -> DataFrame:
    """Distinct scrubbed keys with the cleaned name and the specification found in the name."""
    keys = raw.select(*KEY).where("name <> ''").distinct()
    return keys.withColumn("clean", tx.clean_name("name")).withColumn("order_spec", tx.spec_of("name"))


def line_keys(lines: DataFrame) -> DataFrame:
    """The keys of the lines, stored: filters on a cleaned name would otherwise be moved in front of `distinct`, to all lines."""
    return cut_lineage(keys_of(cut_lineage(raw_keys(lines), "raw")), "line-keys")


def _sku(df: DataFrame) -> Column:
    return F.struct(*[
        (F.coalesce(F.col(c), F.lit("")) if c == "product_spec" else F.col(c)).alias(c) for c in SKU_FIELDS])


def catalog_groups(catalog: DataFrame, name_col: str = "sku_name") -> DataFrame:
    """Catalog rows collapsed by owner, name, unit and specification: row count and first row by code."""
    return (
        catalog.withColumn("_sku", _sku(catalog))
        .groupBy("owner_code", F.col(name_col).alias("hit_name"), F.col("unit").alias("sku_unit"),
                 F.coalesce("product_spec", F.lit("")).alias("sku_spec"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_sku").alias("sku"))
    )


def resolve_aliases(table_aliases: DataFrame, file_aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Alias name to catalog rows. Table aliases come first; a file alias counts only for names the table lacks.

    table_aliases: owner_code, order_name, system_name (looked up without regard to status).
    file_aliases: seq, owner_code (null for every owner), order_name, system_name (ACTIVE rows only; of several
    entries for one name the last counts). Names are scrubbed on both sides.
    """
    cols = ["owner_code", "name", *SKU_FIELDS]
    table = table_aliases.withColumn("name", tx.scrub("order_name", all_zero_width=False)).select("owner_code", "name", "system_name").distinct()
    from_table = table.join(catalog.withColumn("system_name", F.col("sku_name")), ["owner_code", "system_name"]).select(*cols)
    files = file_aliases.withColumn("name", tx.scrub("order_name", all_zero_width=False)).where("name <> '' and system_name <> ''")
    own = files.where("owner_code is not null").groupBy("owner_code", "name").agg(
        F.max_by("system_name", "seq").alias("system_name"), F.max("seq").alias("seq"))
    every = files.where("owner_code is null").groupBy("name").agg(
        F.max_by("system_name", "seq").alias("system_name"), F.max("seq").alias("seq"))
    active = active_catalog(catalog).withColumn("system_name", F.col("sku_name"))
    from_own = (
        own.join(every.select("name", F.col("seq").alias("_other")), "name", "left")
        .where("_other is null or _other < seq").drop("_other")
        .join(active, ["owner_code", "system_name"]).select(*cols)
    )
    from_every = (
        every.join(active, "system_name")
        .join(own.select("owner_code", "name", F.col("seq").alias("_other")), ["owner_code", "name"], "left")
        .where("_other is null or _other < seq").select(*cols)
    )
    from_files = from_own.unionByName(from_every).join(
        from_table.select("owner_code", "name").distinct(), ["owner_code", "name"], "left_anti")
    return from_table.unionByName(from_files)


# --- layers of equal names --------------------------------------------------------------

def lookup_table(catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Catalog groups by the texts that name them: SKU name, customer code (kind 'sku') and alias (kind 'alias')."""
    active = active_catalog(catalog)
    out = catalog_groups(active).unionByName(
        catalog_groups(active.where("customer_code <> sku_name"), "customer_code")).withColumn("kind", F.lit("sku"))
    if aliases is not None:
        out = out.unionByName(catalog_groups(aliases, "name").withColumn("kind", F.lit("alias")))
    return out


def equal_hits(keys: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Groups whose name, code or alias equals the key's name (L0, L1) or cleaned name (L1b): one equi-join for all."""
    changed = (F.col("clean") != F.col("name")) & (F.col("clean") != "")

    def ask(layer: str, kind: str, text: str) -> Column:
        return F.struct(F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), F.col(text).alias("hit_name"))

    asked = [ask("L1", "sku", "name"), F.when(changed, ask("L1b", "sku", "clean"))]
    if aliases is not None:
        asked.append(ask("L0", "alias", "name"))
    rows = keys.withColumn("_a", F.explode(F.array_compact(F.array(*asked)))).select(*keys.columns, "_a.*")
    return rows.join(lookup_table(catalog, aliases), ["owner_code", "kind", "hit_name"]).drop("kind", "hit_name")


def with_spec_points(rows: DataFrame) -> DataFrame:
    """Adds spec_points for (order_spec, sku_spec). Each distinct pair of specifications is scored once."""
    both = rows.where("order_spec <> '' and sku_spec <> ''").select("order_spec", "sku_spec").distinct()
    needs = tx.spec_needs_ratio(F.col("order_spec"), F.col("sku_spec"))
    ratio = sim.seq_ratio(F.when(needs, F.lower("order_spec")), F.when(needs, F.lower("sku_spec")))
    points = both.select("order_spec", "sku_spec", tx.spec_score(F.col("order_spec"), F.col("sku_spec"), ratio).alias("_p"))
    return rows.join(points, ["order_spec", "sku_spec"], "left").withColumn(
        "spec_points", F.coalesce("_p", F.lit(0.5))).drop("_p")


def _unit_totals(tag: str, which: Column | None = None) -> list[Column]:
    """Row counts and first rows of a key, of all its rows or of some: all of them, and those with the order's unit."""
    unit = (F.col("order_unit") != "") & (F.col("sku_unit") == F.col("order_unit"))
    n, sku = F.col("n"), F.col("sku")
    if which is not None:
        n, sku = F.when(which, n).otherwise(0), F.when(which, sku)
    return [F.sum(n).alias(f"n_{tag}"), F.sum(F.when(unit, n).otherwise(0)).alias(f"u_{tag}"),
            F.min(sku).alias(f"b_{tag}"), F.min(F.when(unit, sku)).alias(f"bu_{tag}")]


def choose_by_unit(hits: DataFrame) -> DataFrame:
    """One row per key and layer: a single row, else the only row with the order's unit, else candidates.

    For cleaned names with a specification, of several rows those whose specification scores .5 or more come first,
    if there are any.
    """
    by_spec = (F.col("layer") == "L1b") & (F.col("order_spec") != "")
    plain = hits.where(~by_spec).groupBy(*KEY, "layer").agg(*_unit_totals("all"))
    plain = plain.select(*KEY, "layer", *[F.col(f"{p}_all").alias(p) for p in ("n", "u", "b", "bu")], F.lit(False).alias("by_spec"))
    scored = with_spec_points(hits.where(by_spec))
    agg = scored.groupBy(*KEY, "layer").agg(*_unit_totals("all"), *_unit_totals("fit", F.col("spec_points") >= 0.5))
    fit = (F.col("n_all") > 1) & (F.col("n_fit") > 0)
    spec = agg.select(*KEY, "layer", *[
        F.when(fit, F.col(f"{p}_fit")).otherwise(F.col(f"{p}_all")).alias(p) for p in ("n", "u", "b", "bu")], fit.alias("by_spec"))
    by_unit = (F.col("n") > 1) & (F.col("u") > 0)
    return plain.unionByName(spec).select(
        *KEY, "layer", F.when(by_unit, F.col("bu")).otherwise(F.col("b")).alias("sku"),
        F.when(by_unit, F.col("u")).otherwise(F.col("n")).cast("bigint").alias("n_candidates"),
        by_unit.alias("by_unit"), "by_spec",
    ).withColumn("need_confirm", F.col("n_candidates") > 1)


def _layer_rank() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in fv.LAYER_ORDER]), F.col("layer"))


def first_layer(results: DataFrame) -> DataFrame:
    """Per key the first layer that accepted."""
    cols = [c for c in results.columns if c not in KEY]
    best = results.groupBy(*KEY).agg(F.min_by(F.struct(*cols), _layer_rank()).alias("_r"))
    return best.select(*KEY, "_r.*")


def resolve_equal(keys: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Layers L0 (alias), L1 (name or code) and L1b (cleaned name)."""
    hits = cut_lineage(equal_hits(keys, catalog, aliases), "hits")
    conf = F.create_map(*[F.lit(x) for kv in fv.EQUAL_LAYER_CONFIDENCE.items() for x in kv])
    return first_layer(choose_by_unit(hits)).withColumn("confidence", conf[F.col("layer")])


# --- layers of similar names -----------------------------------------------------------------

def _gate_groups(core: Column, forms: Sequence[str], seasonings: Sequence[str]) -> Column:
    plain = ~core.rlike("|".join(seasonings)) if seasonings else F.lit(True)
    found = tx.words_in(core, forms) if forms else F.array().cast("array<string>")
    return F.when(plain, found).otherwise(F.array().cast("array<string>"))


def _sides(names: DataFrame, sku_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (owner_code, clean, core) and (owner_code, sku_name, core), stored."""
    return (cut_lineage(names.select("owner_code", "clean").distinct().withColumn("core", tx.name_core("clean")), "names"),
            cut_lineage(sku_names.select("owner_code", "sku_name").distinct().withColumn("core", tx.name_core("sku_name")), "sku-names"))


def _contained_pairs(names: DataFrame, skus: DataFrame) -> DataFrame:
    """(owner_code, clean, sku_name) where one name, or one core, contains the other."""

    def both_ways(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, at, bt) where one text contains the other."""
        inside = containment_join(a.withColumnRenamed("t", "needle"), b.withColumnRenamed("t", "hay"), keys, stored=True)
        around = containment_join(b.withColumnRenamed("t", "needle"), a.withColumnRenamed("t", "hay"), keys, stored=True)
        return inside.select(*keys, F.col("needle").alias("at"), F.col("hay").alias("bt")).unionByName(
            around.select(*keys, F.col("hay").alias("at"), F.col("needle").alias("bt"))).distinct()

    own = ["owner_code"]
    contained = both_ways(names.select(*own, F.col("clean").alias("t")), skus.select(*own, F.col("sku_name").alias("t")), own).select(
        "owner_code", F.col("at").alias("clean"), F.col("bt").alias("sku_name"))
    # A pair of cores that are the names themselves is already there, so one of the two has to differ from its name.
    cores = both_ways(names.select(*own, F.col("core").alias("t")), skus.select(*own, F.col("core").alias("t")), own)
    return contained.unionByName(
        cores.join(names.withColumnRenamed("core", "at"), [*own, "at"]).join(skus.withColumnRenamed("core", "bt"), [*own, "bt"])
        .where("at <> clean OR bt <> sku_name").select("owner_code", "clean", "sku_name"))


def _gated(names: DataFrame, skus: DataFrame, forms: Sequence[str], seasonings: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the gates they may meet in beside containment: a shared product-form word, or an empty core."""
    empty = F.col("core") == ""
    none = F.array().cast("array<string>")
    left = names.withColumn("gate", F.explode(F.concat(
        _gate_groups(F.col("core"), forms, seasonings), F.array(F.lit(ANY_GROUP)), F.when(empty, F.array(F.lit(NO_GROUP))).otherwise(none))))
    right = skus.withColumn("gate", F.explode(F.concat(
        _gate_groups(F.col("core"), forms, seasonings), F.array(F.lit(NO_GROUP)), F.when(empty, F.array(F.lit(ANY_GROUP))).otherwise(none))))
    left = cut_lineage(left.join(right.select(*GATE).distinct(), GATE, "left_semi"), "gates")
    return left, cut_lineage(right.join(left.select(*GATE).distinct(), GATE, "left_semi"), "sku-gates")


def _edge_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(owner_code, clean, sku_name) with equal keys where the SKU name holds the first or last two characters of the other."""
    asked = left.select(*keys, "clean", F.explode(F.array_distinct(F.array(
        F.left("clean", F.lit(2)), F.right("clean", F.lit(2))))).alias("edge")).where(F.length("edge") == 2).distinct()
    known = right.select(*keys, "sku_name", F.explode(tx.grams("sku_name", 2)).alias("edge")).distinct()
    return salted_join(known, asked, [*keys, "edge"], F.col("sku_name"), right_id=F.col("clean")).select("owner_code", "clean", "sku_name").distinct()


def candidate_pairs(names: DataFrame, sku_names: DataFrame, forms: Sequence[str] = fv.PRODUCT_FORMS,
                    seasonings: Sequence[str] = fv.SEASONING_WORDS, floor: float = 0.5, edges: bool = True) -> DataFrame:
    """All (owner_code, clean, sku_name) that pass the core-word gate and have a ratio of `floor` or, with edges, a shared name edge.

    The gate is turned into equi-keys: containment of the names or of their cores (gram blocking), a shared
    product-form word, or an empty core. The last two kinds also need a ratio that can reach `floor` (prefix
    filter) or a shared name edge (equi-join on the edge 2-gram). With edges the result is every pair of a gate that
    shares one; the cascade takes only those that can decide a line (`resolve_similar`).
    """
    names, skus = _sides(names, sku_names)
    left, right = _gated(names, skus, forms, seasonings)
    out = _contained_pairs(names, skus).unionByName(similar_pairs(left, right, GATE, "clean", "sku_name", floor).select("owner_code", "clean", "sku_name"))
    if edges:
        out = out.unionByName(_edge_pairs(left, right, GATE))
    return out.distinct()


def shares_edge(clean: Column, sku_name: Column) -> Column:
    """Does the SKU name contain one of the edge keywords? The shortest ones decide."""
    return (F.length(clean) >= 2) & (
        sku_name.contains(F.left(clean, F.lit(2))) | sku_name.contains(F.right(clean, F.lit(2))))


def name_scores(pairs: DataFrame, forms: Sequence[str] = fv.PRODUCT_FORMS,
                seasonings: Sequence[str] = fv.SEASONING_WORDS, floor: float = 0.5) -> DataFrame:
    """Sequence ratio of gated pairs; Python sees only pairs no closed form or bound decides."""
    a, b = F.col("clean"), F.col("sku_name")
    gated = pairs.where(tx.core_word_gate(a, b, forms, seasonings)).withColumn("edge", shares_edge(a, b))
    return sim.with_ratio(gated, "clean", "sku_name", floor, "name_score", also=F.col("edge"))


def score_layers(keys: DataFrame, scored_pairs: DataFrame, catalog: DataFrame, floor: float = 0.5) -> DataFrame:
    """Rows (key, layer, score, …) of L2, L2.5 and L3 for each key and catalog group of its candidates."""
    groups = catalog_groups(active_catalog(catalog)).withColumnRenamed("hit_name", "sku_name")
    rows = keys.join(scored_pairs, ["owner_code", "clean"]).join(groups, ["owner_code", "sku_name"])
    spec, sku_spec = F.col("order_spec"), F.col("sku_spec")
    rows = with_spec_points(cut_lineage(rows, "pair-rows"))
    boost = tx.containment_boost(F.col("clean"), F.col("sku_name"))
    raised = F.when(F.col("name_score") >= 0.7, F.greatest(boost, F.lit(0.25))).otherwise(boost)
    unit = (F.col("order_unit") != "") & (F.col("sku_unit") == F.col("order_unit"))
    same_spec = (spec != "") & (sku_spec != "") & (spec == sku_spec)

    def entry(layer: str, applies: Column, b: Column) -> Column:
        return F.when(applies, F.struct(
            F.lit(layer).alias("layer"),
            sim.match_score(layer, F.col("name_score"), F.col("spec_points"), b, F.coalesce(unit, F.lit(False)), same_spec).alias("score")))

    layers = F.array_compact(F.array(
        entry("L2", F.col("sku_name").contains(F.col("clean")), F.lit(0.0)),
        entry("L2.5", F.col("name_score") >= floor, raised),
        entry("L3", F.col("edge"), boost)))
    return rows.select(*KEY, "clean", "sku_name", "name_score", "spec_points", "n", F.col("sku.sku_code").alias("sku_code"),
                       "sku", F.explode(layers).alias("_l")).select("*", "_l.layer", "_l.score").drop("_l")


def accept_similar(best: DataFrame) -> DataFrame:
    """Acceptance limits of the similar-name layers, applied to best_with_ties output with columns layer and name_score."""
    s, n, layer = F.col("top_score"), F.col("top.name_score"), F.col("layer")
    tie = F.col("n_tied") > 1
    tie_floor = F.when(layer == "L2.5", 0.7).otherwise(0.6)
    tie_ok = (s >= tie_floor) | (n >= 0.7) | ((s >= 0.4) & (n >= 0.6))
    lifted = (layer == "L3") & (s >= 0.55) & (s < 0.6) & (n >= 0.7)
    unique_ok = F.when(layer == "L2.5", s >= 0.7).otherwise((s >= 0.6) | lifted)
    cap = F.when(layer == "L2.5", 0.85).when(layer == "L3", 0.88).otherwise(1.0)
    confidence = F.when(~tie & lifted, F.least(F.lit(0.79), tx.round_half_up(s + 0.2, 2))).otherwise(
        F.least(cap, tx.round_half_up(s, 2)))
    return best.where(F.when(tie, tie_ok).otherwise(unique_ok)).select(
        *KEY, "layer", F.when(tie, F.col("tied.sku")).otherwise(F.col("top.sku")).alias("sku"),
        F.col("n_tied").alias("n_candidates"), (tie | (s < 0.8)).alias("need_confirm"), confidence.alias("confidence"), "top_score")


def _judged(rows: DataFrame) -> DataFrame:
    return accept_similar(best_with_ties(rows, [*KEY, "layer"], "score", "sku_code", ["name_score", "sku"], weight="n"))


def _edge_rows(pairs: DataFrame, floor: float, keys: DataFrame, catalog: DataFrame, forms: Sequence[str], seasonings: Sequence[str]) -> DataFrame:
    """Rows of L3 of the keys for name pairs, which share an edge and are checked by the gate here."""
    a, b = F.col("clean"), F.col("sku_name")
    passed = pairs.where(shares_edge(a, b) & tx.core_word_gate(a, b, forms, seasonings)).withColumn("edge", F.lit(True))
    scored = sim.with_ratio(passed, "clean", "sku_name", floor, "name_score")
    return score_layers(keys, scored, catalog).where("layer = 'L3'")


def _equal_terms_pairs(keys: DataFrame, groups: DataFrame, left: DataFrame, right: DataFrame, limit: float) -> DataFrame:
    """Name pairs below the floor of the similarity join that can still reach the limit of L3.

    Only an equal unit together with a specification lifts such a pair that far. So the unit is an equi-key, in the lower
    stratum the specification as well, and what they add to the score leaves a ratio that the names must have: a prefix filter.
    """
    w = fv.MATCH_WEIGHTS["L3"]
    asked = keys.where("order_unit <> '' and order_spec <> ''").join(left.select(*GATE, "clean"), ["owner_code", "clean"])
    known = groups.where("sku_unit <> '' and sku_spec <> ''").join(right.select(*GATE, "sku_name"), ["owner_code", "sku_name"])
    out = None
    for form, bonus in ((lambda c: c, fv.SPEC_BONUS), (lambda c: F.lit(""), 0.0)):
        floor = (limit - fv.UNIT_BONUS - w["spec"] - bonus) / w["name"] - 1e-6
        terms = [*GATE, "unit", "spec"]
        found = similar_pairs(asked.select(*GATE, F.col("order_unit").alias("unit"), form(F.col("order_spec")).alias("spec"), "clean"),
                              known.select(*GATE, F.col("sku_unit").alias("unit"), form(F.col("sku_spec")).alias("spec"), "sku_name"), terms, "clean", "sku_name", floor)
        found = found.select("owner_code", "clean", "sku_name")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _rival_pairs(won: DataFrame, groups: DataFrame, left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Name pairs whose ratio is below `floor` and that could still pass, or tie with, the best row of a key (KEY, clean, order_spec, top_score).

    A row gets at most what unit and specification add and the floor's share for its name. Where that is not enough
    without an equal unit, the unit is an equi-key; where it never is, the key meets nothing.
    """
    w = fv.MATCH_WEIGHTS["L3"]
    spec_most = F.when(F.col("order_spec") != "", w["spec"] + fv.SPEC_BONUS).otherwise(w["spec"] / 2)
    unit_most = F.when(F.col("order_unit") != "", fv.UNIT_BONUS).otherwise(0.0)
    least = F.col("top_score") - fv.TIE_GAP - 1e-9
    other_unit, same_unit = floor * w["name"] + spec_most, floor * w["name"] + spec_most + unit_most
    open_keys = won.where(same_unit > least).withColumn("wide", other_unit > least)
    asked = open_keys.join(left.select(*GATE, "clean"), ["owner_code", "clean"])
    known = groups.join(right.select(*GATE, "sku_name"), ["owner_code", "sku_name"])
    wide = _edge_pairs(asked.where("wide"), right, GATE)
    narrow = _edge_pairs(asked.where("not wide").withColumn("unit", F.col("order_unit")), known.withColumn("unit", F.col("sku_unit")), [*GATE, "unit"])
    return wide.unionByName(narrow).distinct()


def resolve_similar(keys: DataFrame, catalog: DataFrame, forms: Sequence[str] = fv.PRODUCT_FORMS,
                    seasonings: Sequence[str] = fv.SEASONING_WORDS, floor: float = 0.5, limit: float = 0.6) -> DataFrame:
    """Layers L2 (containment), L2.5 (similarity) and L3 (edge keywords), best first.

    Pairs that contain each other or have a ratio of `floor` decide L2 and L2.5. Keys these leave open go on to L3: its
    pairs below the floor are only looked for where unit and specification can lift them to the limit, and then, for keys
    whose best row would be accepted at a low score, where they could pass or tie with that row.
    """
    usable = cut_lineage(keys.where("clean <> ''"), "usable")
    active = active_catalog(catalog)
    names, skus = _sides(usable, active)
    left, right = _gated(names, skus, forms, seasonings)
    pairs = cut_lineage(_contained_pairs(names, skus).unionByName(
        similar_pairs(left, right, GATE, "clean", "sku_name", floor).select("owner_code", "clean", "sku_name")).distinct(), "pairs")
    rows = cut_lineage(score_layers(usable, name_scores(pairs, forms, seasonings, floor), catalog, floor), "pair-layers")
    early = cut_lineage(first_layer(_judged(rows.where("layer <> 'L3'"))), "early")
    rest = cut_lineage(usable.join(early.select(*KEY), KEY, "left_anti"), "edge-keys")
    groups = catalog_groups(active).withColumnRenamed("hit_name", "sku_name").select("owner_code", "sku_name", "sku_unit", "sku_spec")
    name_pair = ["owner_code", "clean", "sku_name"]
    lifted = cut_lineage(_equal_terms_pairs(rest, groups, left, right, limit).join(pairs, name_pair, "left_anti"), "lifted-pairs")
    w = fv.MATCH_WEIGHTS["L3"]
    lowest = (limit - fv.UNIT_BONUS - w["spec"] - fv.SPEC_BONUS) / w["name"] - 1e-6
    edge = cut_lineage(rows.where("layer = 'L3'").join(rest.select(*KEY), KEY, "left_semi").unionByName(
        _edge_rows(lifted, lowest, rest, catalog, forms, seasonings)), "edge-rows")
    won = cut_lineage(_judged(edge), "edge-won")
    low = rest.join(won.where(F.col("top_score") < limit + fv.TIE_GAP).select(*KEY, "top_score"), KEY)
    rivals = _rival_pairs(low, groups, left, right, floor).join(pairs, name_pair, "left_anti").join(lifted, name_pair, "left_anti")
    more = _edge_rows(rivals, 0.0, low.drop("top_score"), catalog, forms, seasonings)
    again = edge.join(low.select(*KEY), KEY, "left_semi").unionByName(more)
    late = won.where(F.col("top_score") >= limit + fv.TIE_GAP).unionByName(_judged(again))
    return early.unionByName(late)


RESULT = ["layer", "confidence", "need_confirm", "n_candidates", "sku"]


def resolve_keys(keys: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None,
                 forms: Sequence[str] = fv.PRODUCT_FORMS, seasonings: Sequence[str] = fv.SEASONING_WORDS) -> DataFrame:
    """The cascade: keys an equal-name layer settles never reach the similar-name layers."""
    keys = cut_lineage(keys, "keys")
    equal = cut_lineage(resolve_equal(keys, catalog, aliases).select(*KEY, *RESULT), "equal")
    rest = cut_lineage(keys.join(equal.select(*KEY), KEY, "left_anti"), "rest")
    similar = cut_lineage(resolve_similar(rest, catalog, forms, seasonings).select(*KEY, *RESULT), "similar")
    return equal.unionByName(similar)


def attach(lines: DataFrame, raw: DataFrame, results: DataFrame) -> DataFrame:
    """Lines with their result; unmatched lines keep null results and confidence 0."""
    by_raw = raw.join(results, KEY).select(
        "owner_code", F.col("product_name").alias("_p"), F.col("unit").alias("_u"), *RESULT).withColumnRenamed("owner_code", "_o")
    same = (F.col("owner_code") == F.col("_o")) & (F.col("product_name") == F.col("_p")) & F.col("unit").eqNullSafe(F.col("_u"))
    return lines.join(by_raw, same, "left").select(
        *lines.columns, F.col("layer").alias("match_layer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("need_confirm", F.lit(False)).alias("need_confirm"),
        F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"),
        F.col("sku.sku_code").alias("sku_code"), F.col("sku.sku_name").alias("sku_name"),
        F.col("sku.unit").alias("sku_unit"), F.col("sku.unit_type").alias("unit_type"),
        F.col("sku.product_spec").alias("product_spec"), F.col("layer").isNotNull().alias("matched"))


def resolve_lines(lines: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None,
                  forms: Sequence[str] = fv.PRODUCT_FORMS, seasonings: Sequence[str] = fv.SEASONING_WORDS) -> DataFrame:
    raw = cut_lineage(raw_keys(lines), "raw")
    return attach(lines, raw, resolve_keys(keys_of(raw), catalog, aliases, forms, seasonings))


def resolve_lines_equal(lines: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The cascade up to the cleaned name."""
    raw = cut_lineage(raw_keys(lines), "raw")
    return attach(lines, raw, resolve_equal(cut_lineage(keys_of(raw), "keys"), catalog, aliases).select(*KEY, *RESULT))


def equal_candidates(keys: DataFrame, catalog: DataFrame, aliases: DataFrame | None, results: DataFrame) -> DataFrame:
    """Candidate rows (long form) of keys whose equal-name result needs confirmation."""
    open_keys = results.where("need_confirm").select(*KEY, "layer", "by_unit", "by_spec")
    active = active_catalog(catalog)
    k = keys.join(open_keys, KEY)
    by_name = k.where("layer = 'L1'").join(active.withColumn("name", F.col("sku_name")), ["owner_code", "name"])
    by_code = k.where("layer = 'L1'").join(
        active.where("customer_code <> sku_name").withColumn("name", F.col("customer_code")), ["owner_code", "name"])
    clean = k.where("layer = 'L1b'")
    by_clean = clean.join(active.withColumn("clean", F.col("sku_name")), ["owner_code", "clean"]).unionByName(
        clean.join(active.where("customer_code <> sku_name").withColumn("clean", F.col("customer_code")), ["owner_code", "clean"]))
    rows = by_name.unionByName(by_code).unionByName(by_clean)
    if aliases is not None:
        rows = rows.unionByName(
            k.where("layer = 'L0'").join(aliases, ["owner_code", "name"]), allowMissingColumns=True)
    scored = with_spec_points(rows.withColumn("sku_spec", F.coalesce("product_spec", F.lit(""))))
    return scored.where(~F.col("by_unit") | (F.col("unit") == F.col("order_unit"))).where(
        "not by_spec or spec_points >= 0.5").select(*KEY, "layer", *SKU_FIELDS)


# --- unit size class -----------------------------------------------------------------------------

def unit_class(catalog: DataFrame, large: str = "large", medium: str = "medium", small: str = "small") -> DataFrame:
    """Unit and size class of every catalog row. A stored class wins; else the ratio's place among same-name rows."""
    ratio = F.coalesce("conversion_ratio", F.lit(1).cast("decimal(10,2)"))
    span = catalog.groupBy("owner_code", "sku_name").agg(
        F.min(ratio).alias("_lo"), F.max(ratio).alias("_hi"))
    placed = catalog.join(span, ["owner_code", "sku_name"], "left")
    by_ratio = (
        F.when(F.col("_lo").isNull() | (F.col("_lo") == F.col("_hi")), large)
        .when(ratio == F.col("_hi"), large).when(ratio == F.col("_lo"), small).otherwise(medium)
    )
    stored = F.nullif("unit_type", F.lit(""))
    return placed.select("owner_code", "sku_code", F.coalesce(F.nullif("unit", F.lit("")), F.lit(fv.DEFAULT_UNIT)).alias("unit"),
                         F.coalesce(stored, by_ratio).alias("unit_type"))


# --- older ladder -----------------------------------------------------------------------------------

def match_ladder(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Older ladder over a name mapping (owner_code, mapped_name, sku_code, ratio): exact, cleaned, prefix, suffix,
    mapped name inside the name, name inside the mapped name. Per step the largest ratio wins, then the smallest code.
    """
    names = lines.select("owner_code", "product_name").distinct().withColumn("clean", tx.clean_name_hard("product_name"))
    names = cut_lineage(names, "names")
    best = mapping.groupBy("owner_code", "mapped_name").agg(F.min(F.struct(
        (-F.coalesce("ratio", F.lit(0.0))).alias("neg_ratio"), F.col("sku_code").alias("sku_code"))).alias("pick"))
    best = cut_lineage(best, "mapping")
    exact = names.join(best.withColumnRenamed("mapped_name", "product_name"), ["owner_code", "product_name"]).withColumn("step", F.lit(1))
    cleaned = names.where("clean <> product_name and clean <> ''").join(
        best.withColumnRenamed("mapped_name", "clean"), ["owner_code", "clean"]).withColumn("step", F.lit(2))
    found = exact.select("owner_code", "product_name", "step", "pick").unionByName(
        cleaned.select("owner_code", "product_name", "step", "pick"))
    rest = names.where("clean <> ''").join(found.select("owner_code", "product_name"), ["owner_code", "product_name"], "left_anti")
    rest = cut_lineage(rest, "rest")
    needles, mapped = rest.select("owner_code", F.col("clean").alias("t")), best.select("owner_code", "mapped_name")
    inside = containment_join(needles.withColumnRenamed("t", "needle"), mapped.withColumnRenamed("mapped_name", "hay"), ["owner_code"])
    around = containment_join(mapped.withColumnRenamed("mapped_name", "needle"), needles.withColumnRenamed("t", "hay"), ["owner_code"])
    pairs = inside.select("owner_code", F.col("needle").alias("clean"), F.col("hay").alias("mapped_name")).unionByName(
        around.select("owner_code", F.col("hay").alias("clean"), F.col("needle").alias("mapped_name"))).distinct()
    other = F.col("mapped_name") != F.col("clean")
    step = (
        F.when(other & F.col("mapped_name").startswith(F.col("clean")), 3)
        .when(other & F.col("mapped_name").endswith(F.col("clean")), 4)
        .when(F.col("clean").contains(F.col("mapped_name")), 5).otherwise(6)
    )
    fuzzy = rest.join(pairs, ["owner_code", "clean"]).join(best, ["owner_code", "mapped_name"]).select(
        "owner_code", "product_name", step.alias("step"), "pick")
    won = found.unionByName(fuzzy).groupBy("owner_code", "product_name").agg(F.min(F.struct("step", "pick")).alias("w"))
    return lines.join(won, ["owner_code", "product_name"], "left").select(
        *lines.columns, F.col("w.step").cast("bigint").alias("step"), F.col("w.pick.sku_code").alias("sku_code"))
