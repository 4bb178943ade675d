"""How the driver's tables are read as evidence, manifests, units, trials and texts.

Every binding is a DataFrame derived from whole tables; ``*_SQL`` holds the same
derivation as text for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators import integrity
from veriframe.plans.registry import Tables, values
from veriframe.session import bucketed
from veriframe.sources.profiles import STATUSES, profile_v1, profile_v2

V2 = profile_v2()
V1 = profile_v1()

CORE = ("prediction", "context_of_use", "data_quality", "reproducible_compute", "internal_reproduction",
        "uncertainty_quantification", "robustness")
BLOCK_ORDER = CORE + tuple(b for b in V2.blocks if b not in CORE)


def line_facts(t: Tables) -> DataFrame:
    """One attested fact per order line: block from line number and tax, status from the flags."""
    q = F.col("l_quantity")
    code = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 0)
        .when(F.col("l_returnflag") == "R", 1)
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O") & (q <= 10), 2)
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O") & (q <= 14), 3)
        .otherwise(4)
    )
    shift = F.when(F.col("l_tax") >= 0.065, 7).when(F.col("l_tax") >= 0.055, 14).otherwise(0)
    names = F.array(*map(F.lit, BLOCK_ORDER))
    return t.lineitem.select(
        F.col("l_orderkey").alias("package_id"),
        F.element_at(names, F.col("l_linenumber") + shift).alias("block"),
        code.alias("code"),
        F.element_at(F.array(*map(F.lit, STATUSES)), code + 1).alias("status"),
        F.concat(F.lit("n"), F.col("l_linenumber")).alias("artifact_id"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus",
    )


class Dealt(Tables):
    """Tables whose lines and orders are cut to the columns used here and written once, bucketed by order.

    Evidence and the rows of a manifest are derived from them where they lie, as often as a plan asks: nothing derived is written or moved."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, t.dir)
        used = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
        self.lineitem = bucketed(t.lineitem.select(*used), "l_orderkey")
        self.orders = bucketed(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey")


LINES_SQL = f"""lines AS (
 SELECT *, (ARRAY[{', '.join("'" + s + "'" for s in STATUSES)}])[code + 1] AS status,
        (ARRAY[{', '.join("'" + b + "'" for b in BLOCK_ORDER)}])[l_linenumber + shift] AS block,
        'n' || l_linenumber AS artifact_id
 FROM (SELECT *, l_orderkey AS package_id,
   CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 0 WHEN l_returnflag='R' THEN 1
        WHEN l_returnflag='A' AND l_linestatus='O' AND l_quantity<=10 THEN 2
        WHEN l_returnflag='A' AND l_linestatus='O' AND l_quantity<=14 THEN 3 ELSE 4 END AS code,
   CASE WHEN l_tax>=0.065 THEN 7 WHEN l_tax>=0.055 THEN 14 ELSE 0 END AS shift FROM lineitem))"""


def evidence(t: Tables) -> DataFrame:
    """One fact per (order, block); the most severe line status is declared.

    The last required field is absent when a line had no discount, the second is
    blank when no line was taxed, and the rationale is null for very small lines.
    """
    lines = line_facts(t)
    agg = lines.groupBy("package_id", "block").agg(
        F.min("code").alias("code"), F.min("l_discount").alias("lo_discount"), F.max("l_tax").alias("hi_tax"),
        F.max("l_extendedprice").alias("hi_price"), F.min("l_suppkey").alias("suppkey"), F.sum("l_quantity").alias("qty"),
    )
    fields = F.create_map(*[x for b, f in V2.blocks.items() for x in (F.lit(b), F.array(*map(F.lit, f)))])[F.col("block")]
    kept = F.when(F.col("lo_discount") == 0.0, F.slice(fields, F.lit(1), F.size(fields) - 1)).otherwise(fields)
    value = F.col("qty").cast("bigint").cast("string")
    cells = F.transform(kept, lambda f, i: F.when((i == 1) & (F.col("hi_tax") == 0.0), F.lit("  ")).otherwise(value))
    return agg.select(
        "package_id", "block",
        F.element_at(F.array(*map(F.lit, STATUSES)), F.col("code") + 1).alias("status"),
        F.concat(F.lit("supplier:"), F.col("suppkey")).alias("source"),
        F.lit("worst line status").alias("rule"),
        F.when(F.col("hi_price") >= 2000.0, F.lit("aggregated order lines")).alias("rationale"),
        F.map_from_arrays(kept, cells).alias("observations"),
    )


EVIDENCE_SQL = LINES_SQL + f""",
evidence AS (
 SELECT package_id, block, (ARRAY[{', '.join("'" + s + "'" for s in STATUSES)}])[min(code) + 1] AS status,
   min(l_discount) = 0.0 AS last_missing, max(l_tax) = 0.0 AS second_blank, max(l_extendedprice) < 2000.0 AS no_rationale,
   'supplier:' || min(l_suppkey) AS source
 FROM lines GROUP BY package_id, block),
facts AS (SELECT *, CASE WHEN status='passed' AND (last_missing OR second_blank OR no_rationale) THEN 'requires_review' ELSE status END AS effective FROM evidence),
req(claim, block, pos) AS (VALUES {values(V2.relations())}),
spec(block, field, fpos, nf) AS (VALUES {values([(b, f, i, len(fs)) for b, fs in V2.blocks.items() for i, f in enumerate(fs)])}),
packages AS (SELECT o_orderkey AS package_id, o_totalprice, o_orderpriority, o_orderstatus, o_custkey FROM orders)"""

# One decision per (package, claim), relational form.
DOMAIN_SQL = EVIDENCE_SQL + """,
cf AS (SELECT p.package_id, r.claim, r.block, r.pos, coalesce(f.effective,'unknown') AS eff, coalesce(f.status,'unknown') AS declared
  FROM packages p CROSS JOIN req r LEFT JOIN facts f ON f.package_id=p.package_id AND f.block=r.block),
domain AS (SELECT package_id, claim, bool_and(eff='passed') AS ok,
  count(*) FILTER (eff='failed') AS n_failed, count(*) FILTER (eff='requires_review') AS n_requires_review,
  count(*) FILTER (eff='unknown') AS n_unknown, count(*) FILTER (eff='not_applicable') AS n_not_applicable,
  count(*) FILTER (eff='passed') AS n_passed,
  coalesce(string_agg(block, '|' ORDER BY pos) FILTER (eff<>'passed'),'') AS deficits
  FROM cf GROUP BY 1,2)"""


def packages(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("package_id"))


def manifest(t: Tables) -> dict[str, DataFrame]:
    """Provenance manifest of each order: lines as artifacts, attestations and lineage."""
    lines = line_facts(t)
    n = F.col("l_linenumber")
    node = lambda k: F.concat(F.lit("n"), (n + k).cast("string"))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("l_partkey").cast("string"), 256))
    version = F.when(F.col("o_totalprice") < 5000, "1.0.0").otherwise(V2.version)
    back = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)
    return {
        "packages": t.orders.select(
            F.col("o_orderkey").alias("package_id"), F.lit(V2.profile_id).alias("profile_id"),
            version.alias("profile_version"), F.lit(V2.source_hash).alias("profile_hash")),
        "artifacts": lines.select(
            "package_id", "artifact_id", digest.alias("declared_sha256"),
            F.when((F.col("l_tax") == 0.08) & (F.col("l_quantity") > 40), F.lit("sha256:stale")).otherwise(digest).alias("observed_sha256"),
            F.array_compact(F.array(F.when(n > 1, node(-1)), F.when(back, node(1)))).alias("derived_from"),
            F.array(F.concat(F.lit("c"), F.col("l_suppkey") % 7), F.concat(F.lit("d"), F.col("l_partkey") % 11)).alias("cohorts"),
            F.when(F.col("l_suppkey") % 10 == 0, "").otherwise(F.concat(F.lit("s"), F.col("l_suppkey") % 5)).alias("study_id"),
            F.concat(F.lit("g"), F.col("l_partkey") % 3).alias("data_generation_id")),
        "lineage": lines.select(
            "package_id", "block",
            F.when(F.col("l_discount") == 0.09, F.array().cast("array<string>")).otherwise(F.array("artifact_id")).alias("artifact_ids")),
        "attestations": lines.filter(F.col("l_discount") != 0.08).select(
            "package_id", F.when(F.col("l_quantity") == 49, F.lit("undeclared_block")).otherwise(F.col("block")).alias("block"), "status", "artifact_id"),
        "independent_pairs": lines.filter(F.col("l_quantity") > 40).select(
            "package_id", F.col("artifact_id").alias("left_id"),
            F.when(F.col("l_quantity") == 50, F.col("artifact_id")).otherwise(node(1)).alias("right_id")),
        "disjoint_pairs": lines.filter(F.col("l_discount") == 0.05).select(
            "package_id", F.col("artifact_id").alias("left_id"),
            F.when(F.col("l_tax") == 0.0, F.col("artifact_id")).otherwise(node(-1)).alias("right_id")),
    }


def integrity_rows(t: Tables, ev: DataFrame, kinds: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """The manifest above and the evidence as rows of one table, from one scan of the lines.

    Only of ``kinds`` if any are named; without ``content`` the columns that describe an artifact are null."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    me = F.col("artifact_id")
    node = lambda k: F.concat(F.lit("n"), (n + k).cast("string"))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("l_partkey").cast("string"), 256))
    back = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (q > 45)
    sourced = F.col("l_discount") != 0.09

    def row(kind, **values):
        return F.struct(*integrity.row(kind, package_id=F.col("package_id"), **values))

    described = dict(
        declared_sha256=digest, study_id=F.when(F.col("l_suppkey") % 10 == 0, "").otherwise(F.concat(F.lit("s"), F.col("l_suppkey") % 5)),
        data_generation_id=F.concat(F.lit("g"), F.col("l_partkey") % 3),
        cohorts=F.array(F.concat(F.lit("c"), F.col("l_suppkey") % 7), F.concat(F.lit("d"), F.col("l_partkey") % 11))) if content else {}
    every = [
        ("artifact", row("artifact", key=me, flag=(F.col("l_tax") == 0.08) & (q > 40), **described)),
        ("derived", F.when(n > 1, row("derived", key=me, other=node(-1)))),
        ("derived", F.when(back, row("derived", key=me, other=node(1)))),
        ("lineage", row("lineage", key=F.col("block"), flag=sourced)),
        ("source", F.when(sourced, row("source", key=me))),
        ("attested", F.when(F.col("l_discount") != 0.08, row("attested", key=F.when(q == 49, F.lit("undeclared_block")).otherwise(F.col("block")), other=me, status=F.col("status")))),
        ("independent", F.when(q > 40, row("independent", key=me, other=F.when(q == 50, me).otherwise(node(1))))),
        ("disjoint", F.when(F.col("l_discount") == 0.05, row("disjoint", key=me, other=F.when(F.col("l_tax") == 0.0, me).otherwise(node(-1))))),
    ]
    wanted = [r for kind, r in every if not kinds or kind in kinds]
    if not wanted:
        return integrity.block_rows(ev)
    # The package is taken from the line, not from the exploded row, so that rows of bucketed lines are known to lie by package.
    rows = line_facts(t).select("package_id", F.explode(F.array(*wanted)).alias("r")).where("r IS NOT NULL")
    rows = rows.select(*["package_id" if c == "package_id" else f"r.{c}" for c in integrity.NAMES])
    return rows.unionByName(integrity.block_rows(ev)) if not kinds or "block" in kinds else rows


MANIFEST_SQL = EVIDENCE_SQL + f""",
art AS (SELECT package_id, artifact_id, l_linenumber AS n, 'sha256:' || sha256(l_partkey::VARCHAR) AS declared,
  CASE WHEN l_tax=0.08 AND l_quantity>40 THEN 'sha256:stale' ELSE 'sha256:' || sha256(l_partkey::VARCHAR) END AS observed,
  CASE WHEN l_linenumber>1 THEN 'n'||(l_linenumber-1) END AS p1,
  CASE WHEN l_returnflag='R' AND l_linestatus='F' AND l_quantity>45 THEN 'n'||(l_linenumber+1) END AS p2,
  'c'||(l_suppkey%7) AS c1, 'd'||(l_partkey%11) AS c2,
  CASE WHEN l_suppkey%10=0 THEN '' ELSE 's'||(l_suppkey%5) END AS study, 'g'||(l_partkey%3) AS gen FROM lines),
lin AS (SELECT package_id, block, CASE WHEN l_discount=0.09 THEN NULL ELSE artifact_id END AS artifact_id FROM lines),
att AS (SELECT package_id, CASE WHEN l_quantity=49 THEN 'undeclared_block' ELSE block END AS block, status, artifact_id FROM lines WHERE l_discount<>0.08),
ind AS (SELECT package_id, artifact_id AS l, CASE WHEN l_quantity=50 THEN artifact_id ELSE 'n'||(l_linenumber+1) END AS r FROM lines WHERE l_quantity>40),
dis AS (SELECT package_id, artifact_id AS l, CASE WHEN l_tax=0.0 THEN artifact_id ELSE 'n'||(l_linenumber-1) END AS r FROM lines WHERE l_discount=0.05),
edges AS (SELECT DISTINCT e.package_id, e.parent, e.child FROM (
   SELECT package_id, artifact_id AS child, p1 AS parent FROM art WHERE p1 IS NOT NULL UNION
   SELECT package_id, artifact_id, p2 FROM art WHERE p2 IS NOT NULL) e JOIN art k ON k.package_id=e.package_id AND k.artifact_id=e.parent),
refs AS (SELECT package_id, p1 AS a FROM art WHERE p1 IS NOT NULL UNION SELECT package_id, p2 FROM art WHERE p2 IS NOT NULL
   UNION SELECT package_id, artifact_id FROM lin WHERE artifact_id IS NOT NULL UNION SELECT package_id, artifact_id FROM att
   UNION SELECT package_id, l FROM ind UNION SELECT package_id, r FROM ind UNION SELECT package_id, l FROM dis UNION SELECT package_id, r FROM dis)"""

CYCLE_SQL = """,
reach AS (SELECT package_id, parent AS a, child AS b FROM edges UNION
   SELECT r.package_id, r.a, e.child FROM reach r JOIN edges e ON e.package_id=r.package_id AND e.parent=r.b),
onc AS (SELECT package_id, a FROM reach WHERE a=b),
core AS (SELECT DISTINCT n.package_id, n.a FROM (SELECT package_id, parent AS a FROM edges UNION SELECT package_id, child FROM edges) n
  WHERE (EXISTS (SELECT 1 FROM onc o WHERE o.package_id=n.package_id AND o.a=n.a)) OR
  (EXISTS (SELECT 1 FROM reach r JOIN onc o ON o.package_id=r.package_id AND o.a=r.a WHERE r.package_id=n.package_id AND r.b=n.a)
   AND EXISTS (SELECT 1 FROM reach r JOIN onc o ON o.package_id=r.package_id AND o.a=r.b WHERE r.package_id=n.package_id AND r.a=n.a)))"""

INTEGRITY_SQL = MANIFEST_SQL + CYCLE_SQL + """,
integ AS (
 SELECT package_id, 'profile_identity_mismatch' AS code, 'version' AS witness FROM packages WHERE o_totalprice<5000
 UNION ALL SELECT package_id, 'duplicate_artifact_id', artifact_id FROM art GROUP BY 1,2,3 HAVING count(*)>1
 UNION ALL SELECT package_id, 'duplicate_block_lineage', block FROM lin GROUP BY 1,2,3 HAVING count(*)>1
 UNION ALL SELECT DISTINCT package_id, 'artifact_hash_mismatch', artifact_id FROM art WHERE declared<>observed
 UNION ALL SELECT package_id, 'unknown_provenance_reference', a FROM refs WHERE (package_id, a) NOT IN (SELECT package_id, artifact_id FROM art)
 UNION ALL SELECT DISTINCT package_id, 'unknown_block_reference', block FROM att WHERE (package_id, block) NOT IN (SELECT package_id, block FROM evidence)
 UNION ALL SELECT package_id, 'missing_block_lineage', block FROM lin GROUP BY 1,2,3 HAVING count(artifact_id)=0
 UNION ALL SELECT package_id, 'missing_block_attestation', block FROM evidence WHERE (package_id, block) NOT IN (SELECT package_id, block FROM att)
 UNION ALL SELECT package_id, 'provenance_cycle', min(a) FROM core GROUP BY 1,2
 UNION ALL SELECT DISTINCT package_id, 'duplicate_independent_artifact', l||'|'||r||':reflexive' FROM ind WHERE l=r
 UNION ALL SELECT DISTINCT i.package_id, 'duplicate_independent_artifact', i.l||'|'||i.r FROM ind i
   JOIN art a ON a.package_id=i.package_id AND a.artifact_id=i.l JOIN art b ON b.package_id=i.package_id AND b.artifact_id=i.r
   WHERE i.l<>i.r AND (a.declared=b.declared OR (a.study<>'' AND a.study=b.study AND a.gen=b.gen))
 UNION ALL SELECT DISTINCT package_id, 'overlapping_independent_cohorts', l||'|'||r||':reflexive' FROM dis WHERE l=r
 UNION ALL SELECT DISTINCT i.package_id, 'overlapping_independent_cohorts', i.l||'|'||i.r||':'||c.cohort FROM dis i
   JOIN (SELECT package_id, artifact_id, c1 AS cohort FROM art UNION SELECT package_id, artifact_id, c2 FROM art) c ON c.package_id=i.package_id AND c.artifact_id=i.l
   JOIN (SELECT package_id, artifact_id, c1 AS cohort FROM art UNION SELECT package_id, artifact_id, c2 FROM art) d ON d.package_id=i.package_id AND d.artifact_id=i.r AND d.cohort=c.cohort
   WHERE i.l<>i.r
 UNION ALL SELECT package_id, 'contradictory_attestation', block FROM att GROUP BY 1,2,3 HAVING count(DISTINCT status)>1
 UNION ALL SELECT DISTINCT a.package_id, 'attestation_block_status_mismatch', a.block||':'||e.status||'!='||a.status||'@'||a.artifact_id
   FROM att a JOIN evidence e ON e.package_id=a.package_id AND e.block=a.block WHERE e.status<>a.status)"""


# ---- normalized claim evidence: one case per order ------------------------

def claim_cases(t: Tables) -> DataFrame:
    """Scores and flags of each order from its lines; ``truth`` is a claim mask from the order row."""
    from veriframe.operators.gates import bits

    r6 = lambda c: F.round(c, 6)
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        r6(F.avg("l_discount") * 10).alias("predictive_score"),
        r6(F.avg("l_quantity") / 50).alias("reproducibility_score"),
        r6(F.avg("l_tax")).alias("topology_effect"),
        F.bool_or(F.col("l_returnflag") == "R").alias("topology_specific"),
        r6(F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0))).alias("directed_fraction"),
        r6(F.min("l_discount") - 0.01).alias("structure_function_effect"),
        r6(F.avg("l_tax") / 2 - 0.01).alias("matched_structure_function_effect"),
        (F.sum("l_quantity") > 60).alias("structure_function_fdr_passed"),
        (F.max("l_quantity") >= 45).alias("causal_evidence"),
        (F.count("*") >= 5).alias("whole_brain_coverage"),
        (F.min("l_tax") < 0.005).alias("independent_validation"),
        (F.max("l_discount") < 0.095).alias("reproducible_compute"),
    )
    o = t.orders
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    flag = lambda cond, *claims: F.when(cond, F.lit(bits(*claims))).otherwise(0)
    p, r = price > 150000, status != "F"
    topo = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    d = (price > 100000) & (status == "O")
    truth = (
        flag(p, "predictive") + flag(r, "reproducible") + flag(topo, "topology_specific") + flag(d, "directed")
        + flag(F.col("o_orderpriority") == "5-LOW", "structure_function") + flag(p & r & topo & d, "mechanistic")
        + flag(price > 400000, "causal") + flag((price > 450000) & (status == "O"), "digital_twin")
    )
    return per.join(o.select(F.col("o_orderkey").alias("case_id"), truth.alias("truth"), F.col("o_orderpriority").alias("regime"),
                             status.alias("noise"), F.col("o_custkey").alias("unit_id")), "case_id")


CASES_SQL = """raw AS (SELECT l_orderkey AS case_id, round(avg(l_discount)*10,6) AS predictive_score, round(avg(l_quantity)/50,6) AS reproducibility_score,
  round(avg(l_tax),6) AS topology_effect, bool_or(l_returnflag='R') AS topology_specific, round(avg(CASE WHEN l_linestatus='F' THEN 1.0 ELSE 0.0 END),6) AS directed_fraction,
  round(min(l_discount)-0.01,6) AS structure_function_effect, round(avg(l_tax)/2-0.01,6) AS matched_structure_function_effect,
  sum(l_quantity)>60 AS structure_function_fdr_passed, max(l_quantity)>=45 AS causal_evidence, count(*)>=5 AS whole_brain_coverage,
  min(l_tax)<0.005 AS independent_validation, max(l_discount)<0.095 AS reproducible_compute FROM lineitem GROUP BY 1),
cases AS (SELECT raw.*, o_orderpriority AS regime, o_orderstatus AS noise, o_custkey AS unit_id,
  CASE WHEN o_totalprice>150000 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus<>'F' THEN 2 ELSE 0 END + CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 4 ELSE 0 END
  + CASE WHEN o_totalprice>100000 AND o_orderstatus='O' THEN 8 ELSE 0 END + CASE WHEN o_orderpriority='5-LOW' THEN 16 ELSE 0 END
  + CASE WHEN o_totalprice>150000 AND o_orderstatus='O' AND o_orderpriority IN ('1-URGENT','2-HIGH') THEN 32 ELSE 0 END
  + CASE WHEN o_totalprice>400000 THEN 64 ELSE 0 END + CASE WHEN o_totalprice>450000 AND o_orderstatus='O' THEN 128 ELSE 0 END AS truth
  FROM raw JOIN orders ON o_orderkey=case_id)"""


def gate_sql(src: str = "cases", keep: str = "case_id, truth", p="0.30", r="0.70", t="0.05", d="0.50", s="0.010") -> str:
    """The gate as SQL text: allowed mask per row of ``src``."""
    P, R = f"predictive_score>={p}", f"reproducibility_score>={r}"
    T, D = f"(topology_specific AND topology_effect>={t})", f"directed_fraction>={d}"
    S = f"(structure_function_effect>0 AND matched_structure_function_effect>={s} AND structure_function_fdr_passed)"
    return f"""SELECT {keep}, ({P})::INT + ({R})::INT*2 + {T}::INT*4 + ({D})::INT*8 + {S}::INT*16 + ({P} AND {R} AND {T} AND {D})::INT*32
      + causal_evidence::INT*64 + (whole_brain_coverage AND independent_validation AND reproducible_compute AND causal_evidence)::INT*128 AS allowed FROM {src}"""


CLAIM8_SQL = "claim8(claim, bit) AS (VALUES ('predictive',1),('reproducible',2),('topology_specific',4),('directed',8),('structure_function',16),('mechanistic',32),('causal',64),('digital_twin',128))"


def hash_mod_sql(text: str, k: int) -> str:
    out = "0"
    for start in range(1, 64, 8):
        out = f"(({out})::BIGINT * {(1 << 32) % k} + ('0x' || substr(sha256({text}), {start}, 8))::BIGINT) % {k}"
    return f"({out})"


def hash_index_sql(text: str, n: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 15))::BIGINT % ({n})::BIGINT)"


def hash_unit_sql(text: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 13))::BIGINT / {float(1 << 52)!r})"
