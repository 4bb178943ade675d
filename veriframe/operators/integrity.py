"""Integrity gate over manifest tables: every deficit is reported, none hides another.

A manifest is a dict of DataFrames keyed by ``package_id``: ``packages``,
``artifacts``, ``lineage``, ``attestations``, ``independent_pairs``,
``disjoint_pairs``.  Deficits are rows ``(package_id, code, witness)`` so that a
package with very many witnesses never becomes one array in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.operators import cycles
from veriframe.session import bucketed, cut
from veriframe.sources.profiles import Profile

# Deficit codes.
CODES = (
    "profile_identity_mismatch",
    "duplicate_artifact_id",
    "duplicate_block_lineage",
    "artifact_hash_mismatch",
    "unknown_provenance_reference",
    "provenance_cycle",
    "duplicate_independent_artifact",
    "overlapping_independent_cohorts",
    "contradictory_attestation",
    "attestation_block_status_mismatch",
    "unknown_block_reference",
    "missing_block_lineage",
    "missing_block_attestation",
)
#: Evidence with two rows of one block is not accepted; the manifest codes above know no such case.
REFUSED = "duplicate_evidence_block"
# Fixed value: accepted hash format.
HASH_FORMAT = "^sha256:[0-9a-f]{64}$"


def _deficit(df: DataFrame, code: str, witness) -> DataFrame:
    return df.select("package_id", F.lit(code).alias("code"), witness.alias("witness"))


def profile_identity(packages: DataFrame, profile: Profile) -> DataFrame:
    ours = (
        F.col("profile_id").eqNullSafe(profile.profile_id)
        & F.col("profile_version").eqNullSafe(profile.version)
        & F.col("profile_hash").eqNullSafe(profile.source_hash)
    )
    return _deficit(packages.filter(~ours), "profile_identity_mismatch",
                    F.concat_ws("|", "profile_id", "profile_version", "profile_hash"))


def duplicate_artifacts(artifacts: DataFrame) -> DataFrame:
    twice = artifacts.groupBy("package_id", "artifact_id").count().filter("count > 1")
    return _deficit(twice, "duplicate_artifact_id", F.col("artifact_id"))


def duplicate_lineages(lineage: DataFrame) -> DataFrame:
    twice = lineage.groupBy("package_id", "block").count().filter("count > 1")
    return _deficit(twice, "duplicate_block_lineage", F.col("block"))


def hash_mismatch(artifacts: DataFrame) -> DataFrame:
    good = F.coalesce(F.col("declared_sha256").rlike(HASH_FORMAT), F.lit(False)) & F.col(
        "declared_sha256"
    ).eqNullSafe(F.col("observed_sha256"))
    return _deficit(artifacts.filter(~good), "artifact_hash_mismatch", F.col("artifact_id")).distinct()


def references(manifest: dict[str, DataFrame]) -> DataFrame:
    """Every artifact id mentioned anywhere, one row per package and id."""
    pairs = manifest["independent_pairs"].unionByName(manifest["disjoint_pairs"])
    parts = [
        manifest["artifacts"].select("package_id", F.explode("derived_from").alias("artifact_id")),
        manifest["lineage"].select("package_id", F.explode("artifact_ids").alias("artifact_id")),
        manifest["attestations"].select("package_id", "artifact_id"),
        pairs.select("package_id", F.explode(F.array("left_id", "right_id")).alias("artifact_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def unknown_references(manifest: dict[str, DataFrame]) -> DataFrame:
    """Tag declared and referenced ids, then keep ids that were only referenced (one shuffle)."""
    tagged = references(manifest).withColumn("declared", F.lit(0)).unionByName(
        manifest["artifacts"].select("package_id", "artifact_id", F.lit(1).alias("declared"))
    )
    lost = tagged.groupBy("package_id", "artifact_id").agg(F.max("declared").alias("declared")).filter("declared = 0")
    return _deficit(lost, "unknown_provenance_reference", F.col("artifact_id"))


def block_closure(manifest: dict[str, DataFrame], evidence: DataFrame) -> DataFrame:
    """Unknown blocks, blocks without lineage and blocks without attestation in one aggregate."""
    zero, one = F.lit(0), F.lit(1)
    tagged = (
        evidence.select("package_id", "block", one.alias("supplied"), zero.alias("lineage"), zero.alias("sources"), zero.alias("attested"))
        .unionByName(manifest["lineage"].select(
            "package_id", "block", zero.alias("supplied"), one.alias("lineage"),
            (F.size("artifact_ids") > 0).cast("int").alias("sources"), zero.alias("attested")))
        .unionByName(manifest["attestations"].select(
            "package_id", "block", zero.alias("supplied"), zero.alias("lineage"), zero.alias("sources"), one.alias("attested")))
    )
    flags = tagged.groupBy("package_id", "block").agg(*[F.max(c).alias(c) for c in ("supplied", "lineage", "sources", "attested")])
    code = F.explode(F.array_compact(F.array(
        F.when(F.col("supplied") == 0, F.lit("unknown_block_reference")),
        F.when((F.col("supplied") == 1) & (F.col("sources") == 0), F.lit("missing_block_lineage")),
        F.when((F.col("supplied") == 1) & (F.col("attested") == 0), F.lit("missing_block_attestation")),
    )))
    return flags.select("package_id", code.alias("code"), F.col("block").alias("witness"))


def provenance_edges(artifacts: DataFrame) -> DataFrame:
    known = artifacts.select("package_id", F.col("artifact_id").alias("parent")).distinct()
    return (
        artifacts.select("package_id", F.col("artifact_id").alias("child"), F.explode("derived_from").alias("parent"))
        .distinct()
        .join(known, ["package_id", "parent"], "left_semi")
    )


def provenance_cycles(artifacts: DataFrame) -> DataFrame:
    paths = cycles.cycle_paths(provenance_edges(artifacts))
    return _deficit(paths.where("position = 0"), "provenance_cycle", F.col("smallest"))


def _sides(pairs: DataFrame, artifacts: DataFrame, columns: list[str]) -> DataFrame:
    left = artifacts.select("package_id", F.col("artifact_id").alias("left_id"), *[F.col(c).alias("l_" + c) for c in columns])
    right = artifacts.select("package_id", F.col("artifact_id").alias("right_id"), *[F.col(c).alias("r_" + c) for c in columns])
    return pairs.distinct().join(left, ["package_id", "left_id"]).join(right, ["package_id", "right_id"])


def dependent_pairs(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Declared-independent pairs that are reflexive, share content or share study and generation."""
    code = "duplicate_independent_artifact"
    label = F.concat_ws("|", "left_id", "right_id")
    reflexive = _deficit(pairs.filter("left_id = right_id").distinct(), code, F.concat(label, F.lit(":reflexive")))
    content = artifacts.select("package_id", "artifact_id", "declared_sha256", "study_id", "data_generation_id").distinct()
    both = _sides(pairs.filter("left_id <> right_id"), content, ["declared_sha256", "study_id", "data_generation_id"])
    shared = both.filter(
        (F.col("l_declared_sha256") == F.col("r_declared_sha256"))
        | ((F.col("l_study_id") != "") & (F.col("l_data_generation_id") != "")
           & (F.col("l_study_id") == F.col("r_study_id"))
           & (F.col("l_data_generation_id") == F.col("r_data_generation_id")))
    )
    return reflexive.unionByName(_deficit(shared, code, label)).distinct()


def overlapping_cohorts(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Declared-disjoint pairs that are reflexive or share a cohort (equi join on the cohort)."""
    code = "overlapping_independent_cohorts"
    label = F.concat_ws("|", "left_id", "right_id")
    reflexive = _deficit(pairs.filter("left_id = right_id").distinct(), code, F.concat(label, F.lit(":reflexive")))
    cohort = artifacts.select("package_id", "artifact_id", F.explode("cohorts").alias("cohort")).distinct()
    left = cohort.withColumnRenamed("artifact_id", "left_id")
    right = cohort.withColumnRenamed("artifact_id", "right_id")
    shared = (
        pairs.filter("left_id <> right_id").distinct()
        .join(left, ["package_id", "left_id"])
        .join(right, ["package_id", "right_id", "cohort"])
    )
    return reflexive.unionByName(_deficit(shared, code, F.concat(label, F.lit(":"), F.col("cohort"))))


def contradictory_attestations(attestations: DataFrame) -> DataFrame:
    mixed = attestations.groupBy("package_id", "block").agg(
        F.min("status").alias("lo"), F.max("status").alias("hi")
    ).filter("lo <> hi")
    return _deficit(mixed, "contradictory_attestation", F.col("block"))


def attestation_mismatch(attestations: DataFrame, evidence: DataFrame) -> DataFrame:
    stated = attestations.select("package_id", "block", "status", "artifact_id").distinct()
    joined = stated.join(
        evidence.select("package_id", "block", F.col("status").alias("block_status")), ["package_id", "block"]
    ).filter("status <> block_status")
    return _deficit(
        joined, "attestation_block_status_mismatch",
        F.concat(F.col("block"), F.lit(":"), F.col("block_status"), F.lit("!="), F.col("status"), F.lit("@"), F.col("artifact_id")),
    )


#: One manifest and its evidence as rows of one table; ``kind`` tells what the other columns hold.
ROWS = (
    "kind string, package_id long, key string, other string, status string, flag boolean, "
    "declared_sha256 string, study_id string, data_generation_id string, cohorts array<string>"
)
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def row(kind: str, **values: Column) -> list[Column]:
    """Columns of one row of ``kind``; those not given are null.

    artifact: id as key, flag if the hash fails, content columns. derived: child, parent. lineage: block,
    flag if it has sources. source: artifact. attested: block, artifact, status.
    independent, disjoint: left, right. block: name, status."""
    types = dict(c.split(" ", 1) for c in ROWS.split(", "))
    values["kind"] = F.lit(kind)
    return [(values[n] if n in values else F.lit(None)).cast(types[n]).alias(n) for n in NAMES]


def hash_holds() -> Column:
    """Declared and observed content hashes are one well-formed value."""
    declared = F.col("declared_sha256")
    return F.coalesce(declared.rlike(HASH_FORMAT), F.lit(False)) & declared.eqNullSafe(F.col("observed_sha256"))


def block_rows(evidence: DataFrame) -> DataFrame:
    return evidence.select(*row("block", package_id=F.col("package_id"), key=F.col("block"), status=F.col("status")))


def manifest_rows(manifest: dict[str, DataFrame], evidence: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The tables of a manifest and the evidence as one table of ``ROWS``; only of ``kinds`` if any are named."""
    c = F.col
    arts, lineage = manifest["artifacts"], manifest["lineage"]
    content = {n: c(n) for n in ("declared_sha256", "study_id", "data_generation_id", "cohorts")}
    derived = arts.select("package_id", "artifact_id", F.explode("derived_from").alias("parent"))
    sources = lineage.select("package_id", F.explode("artifact_ids").alias("artifact_id"))
    package = {"package_id": c("package_id")}
    parts = [
        ("artifact", arts.select(*row("artifact", **package, key=c("artifact_id"), flag=~hash_holds(), **content))),
        ("derived", derived.select(*row("derived", **package, key=c("artifact_id"), other=c("parent")))),
        ("lineage", lineage.select(*row("lineage", **package, key=c("block"), flag=F.size("artifact_ids") > 0))),
        ("source", sources.select(*row("source", **package, key=c("artifact_id")))),
        ("attested", manifest["attestations"].select(*row("attested", **package, key=c("block"), other=c("artifact_id"), status=c("status")))),
        *[(kind, manifest[f"{kind}_pairs"].select(*row(kind, **package, key=c("left_id"), other=c("right_id")))) for kind in ("independent", "disjoint")],
        ("block", block_rows(evidence)),
    ]
    wanted = [part for kind, part in parts if not kinds or kind in kinds]
    out = wanted[0]
    for part in wanted[1:]:
        out = out.unionByName(part)
    return out


#: A table of ``ROWS``, or what gives the rows of named kinds: see `deficits_in_place`.
Rows = DataFrame | Callable[..., DataFrame]


def of_kinds(rows: Rows, *kinds: str, content: bool = False) -> DataFrame:
    if isinstance(rows, DataFrame):
        return rows.where(F.col("kind").isin(*kinds))
    return rows(*kinds, content=content)


def counted_deficits(rows: DataFrame) -> DataFrame:
    """All codes that need only counts per artifact or block, and the duplicate blocks that are refused: one pass, one shuffle."""
    kind, key, other = F.col("kind"), F.col("key"), F.col("other")
    no, yes = F.lit(False), F.lit(True)

    def mention(artifact: bool, name, declared=no, bad=no, referred=no, lineage=no, sources=no, attested=no, status=None, supplied=no):
        status = F.lit(None).cast("long") if status is None else status
        return F.struct(
            F.lit(artifact).alias("artifact"), name.alias("name"), declared.alias("declared"), bad.alias("bad"), referred.alias("referred"), lineage.alias("lineage"),
            sources.alias("sources"), attested.alias("attested"), status.alias("status"), supplied.alias("supplied"))

    flag = F.coalesce("flag", no)
    # A row mentions its key, and some kinds an artifact besides; nulls are dropped after the explode, which stays in generated code.
    mentions = F.array(
        F.when(kind == "artifact", mention(True, key, declared=yes, bad=flag)).when(kind == "lineage", mention(False, key, lineage=yes, sources=flag))
        .when(kind == "attested", mention(False, key, attested=yes, status=F.xxhash64("status"))).when(kind == "block", mention(False, key, supplied=yes))
        .when(kind.isin("source", "independent", "disjoint"), mention(True, key, referred=yes)),
        F.when(kind.isin("independent", "disjoint", "derived", "attested"), mention(True, other, referred=yes)),
    )
    m = rows.select("package_id", F.explode(mentions).alias("m")).where("m IS NOT NULL").select("package_id", "m.*")
    per = m.groupBy("package_id", "artifact", "name").agg(
        *[F.count_if(c).alias(f"n_{c}") for c in ("declared", "lineage", "supplied")],
        *[F.bool_or(c).alias(c) for c in ("bad", "referred", "sources", "attested")],
        F.min("status").alias("lo"), F.max("status").alias("hi"))
    artifact, supplied = F.col("artifact"), F.col("n_supplied") > 0
    block, known = ~artifact, F.col("n_declared") > 0
    codes = F.array(
        F.when(artifact & (F.col("n_declared") > 1), F.lit("duplicate_artifact_id")),
        F.when(artifact & F.col("bad"), F.lit("artifact_hash_mismatch")),
        F.when(artifact & F.col("referred") & ~known, F.lit("unknown_provenance_reference")),
        F.when(block & (F.col("n_lineage") > 1), F.lit("duplicate_block_lineage")),
        F.when(block & ~supplied, F.lit("unknown_block_reference")),
        F.when(block & supplied & ~F.col("sources"), F.lit("missing_block_lineage")),
        F.when(block & supplied & ~F.col("attested"), F.lit("missing_block_attestation")),
        F.when(block & (F.col("lo") != F.col("hi")), F.lit("contradictory_attestation")),
        F.when(block & (F.col("n_supplied") > 1), F.lit(REFUSED)),
    )
    return per.select("package_id", F.explode(codes).alias("code"), F.col("name").alias("witness")).where("code IS NOT NULL")


def pair_deficits(rows: Rows) -> DataFrame:
    """Declared pairs, both kinds at once: reflexive ones, shared content or origin, shared cohorts."""
    pairs = of_kinds(rows, "independent", "disjoint").select("package_id", "kind", F.col("key").alias("left_id"), F.col("other").alias("right_id")).distinct()
    # Only artifacts of a pair are moved to it.
    names = F.when(F.col("kind") == "artifact", F.array("key")).when(F.col("kind").isin("independent", "disjoint") & (F.col("key") != F.col("other")), F.array("key", "other"))
    columns = ["declared_sha256", "study_id", "data_generation_id", "cohorts"]
    own = pairs.filter("left_id <> right_id").select("package_id").distinct()
    named = of_kinds(rows, "independent", "disjoint", "artifact", content=True).join(own.hint("shuffle_hash"), "package_id", "left_semi")
    named = named.select("package_id", "kind", *columns, F.explode(names).alias("key"))
    asked = [F.max((F.col("kind") == kind).cast("int")).over(W.partitionBy("package_id", "key")) for kind in ("independent", "disjoint")]
    held = named.withColumns({"_independent": asked[0] == 1, "_disjoint": asked[1] == 1}).where("kind = 'artifact' AND (_independent OR _disjoint)")
    # Contents and origins are only compared within a package, so their places in its order are moved in place of texts.
    origin = F.when((F.col("study_id") != "") & (F.col("data_generation_id") != ""), F.struct("study_id", "data_generation_id"))
    place = lambda c: F.when(F.col("_independent") & c.isNotNull(), F.dense_rank().over(W.partitionBy("package_id").orderBy(c)))
    content = held.select("package_id", "key", place(F.col("declared_sha256")).alias("hash"), place(origin).alias("origin"), F.when(F.col("_disjoint"), F.col("cohorts")).alias("cohorts")).distinct()

    def side(name: str, tag: str) -> DataFrame:
        return content.select("package_id", F.col("key").alias(name), *[F.col(c).alias(f"{tag}_{c}") for c in content.columns[2:]])

    label, code = F.concat_ws("|", "left_id", "right_id"), F.when(F.col("kind") == "independent", "duplicate_independent_artifact").otherwise("overlapping_independent_cohorts")
    reflexive = pairs.filter("left_id = right_id").select("package_id", code.alias("code"), F.concat(label, F.lit(":reflexive")).alias("witness"))
    both = pairs.filter("left_id <> right_id").join(side("left_id", "l").hint("merge"), ["package_id", "left_id"]).join(side("right_id", "r").hint("merge"), ["package_id", "right_id"])
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    same = F.coalesce(l("hash") == r("hash"), F.lit(False)) | F.coalesce(l("origin") == r("origin"), F.lit(False))
    shared = F.coalesce(F.array_intersect(l("cohorts"), r("cohorts")), F.array().cast("array<string>"))
    witnesses = F.when(F.col("kind") == "disjoint", F.transform(shared, lambda c: F.concat(label, F.lit(":"), c))).otherwise(F.when(same, F.array(label)).otherwise(F.array().cast("array<string>")))
    found = both.select("package_id", code.alias("code"), F.explode(witnesses).alias("witness")).distinct()
    return reflexive.unionByName(found)


def stated_mismatch(rows: Rows) -> DataFrame:
    """Attestations whose status differs from that of the supplied block.

    Statuses of blocks are compared first, in one aggregate; only packages that have a block with several are joined."""
    mark = F.xxhash64("status")
    odd = of_kinds(rows, "attested", "block").groupBy("package_id", "key").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("package_id").distinct()

    def told(kind: str) -> DataFrame:
        return of_kinds(rows, kind).join(odd.hint("shuffle_hash"), "package_id", "left_semi").select("package_id", F.col("key").alias("block"), "status", F.col("other").alias("artifact_id"))

    blocks = told("block").select("package_id", "block", "status").distinct()
    return attestation_mismatch(told("attested"), blocks.hint("merge"))


def cycle_deficits(rows: Rows) -> DataFrame:
    """Smallest artifact of the cyclic core of each package that has one.

    Most packages are settled by the order of ids before any reference is resolved."""
    stated = of_kinds(rows, "derived").select("package_id", F.col("key").alias("child"), F.col("other").alias("parent"))
    open_packages = cut(cycles.undecided(stated).select("package_id"))
    known = of_kinds(rows, "artifact").join(open_packages.hint("shuffle_hash"), "package_id", "left_semi").select("package_id", F.col("key").alias("parent")).distinct()
    edges = stated.join(open_packages.hint("shuffle_hash"), "package_id", "left_semi").distinct().join(known.hint("merge"), ["package_id", "parent"], "left_semi")
    return _deficit(cycles.cycle_paths(edges).where("position = 0"), "provenance_cycle", F.col("smallest"))


def deficits_in_place(rows_of: Callable[..., DataFrame], packages: DataFrame, profile: Profile) -> DataFrame:
    """All deficit rows of all packages from rows that lie by package already, such as those derived from bucketed tables.

    ``rows_of(*kinds, content)`` gives the ``ROWS`` of these kinds (all if none is named), with null for what describes an artifact unless
    ``content``. It is asked anew for every step, so the rows themselves are never written."""
    parts = [profile_identity(packages, profile), counted_deficits(rows_of(content=False)), cycle_deficits(rows_of), pair_deficits(rows_of), stated_mismatch(rows_of)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def deficits_of(rows: DataFrame, packages: DataFrame, profile: Profile) -> DataFrame:
    """All deficit rows of all packages from a table of ``ROWS`` in any order; it is written once, bucketed by package."""
    rows = bucketed(rows, "package_id")
    return deficits_in_place(lambda *kinds, content: of_kinds(rows, *kinds) if kinds else rows, packages, profile)


def deficits(manifest: dict[str, DataFrame], evidence: DataFrame, profile: Profile, in_place: bool = False) -> DataFrame:
    """All deficit rows of all packages; a block supplied twice is refused under the code ``REFUSED``.

    ``in_place``: all tables are projections of one that is bucketed by package, so their rows aren't written once more."""
    if in_place:
        return deficits_in_place(lambda *kinds, content: manifest_rows(manifest, evidence, kinds), manifest["packages"], profile)
    return deficits_of(manifest_rows(manifest, evidence), manifest["packages"], profile)


def code_counts(rows: DataFrame) -> DataFrame:
    """Canonical trace: codes in order with witness counts, at most 13 entries per package."""
    per = rows.groupBy("package_id", "code").agg(F.count("*").alias("n"))
    return per.groupBy("package_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat_ws(":", x["code"], x["n"])).alias("trace"),
        F.count("*").alias("n_codes"),
        F.sum("n").alias("n_witnesses"),
    )
