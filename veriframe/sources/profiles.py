"""Claim profiles: the fixed vocabularies and loaders for user-supplied ones."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Evidence statuses, severity order used by the prioritized rules.
STATUSES = ("failed", "requires_review", "unknown", "not_applicable", "passed")

# Evidence blocks and the observations a passed block must declare.
V2_BLOCKS_TEXT = """
prediction: target target_population split split_integrity metric threshold comparator value
reproducible_compute: source_revision environment entrypoint artifact_revision
internal_reproduction: unit partition_a partition_b overlap agreement_metric threshold value
external_replication: study_id data_generation_id laboratory independence_basis endpoint value
topology_specificity: topology_scale candidate control_family complexity_matching metric margin
directed_identifiability: model_class assumptions calibration_domain directional_test abstention_rule direction
structure_function_association: tissue functional_descriptor connected_pairs matched_controls matching_variables estimate
causal_intervention: design_type estimand intervention outcome identification_assumptions effect
whole_brain_coverage: atlas included_regions excluded_regions spatial_resolution cellular_resolution
independent_validation: validation_resource construction_resource independence_basis locked_endpoint result
entity_specificity: entity_id calibration_data identity_link state_time update_policy
operational_compute: hardware runtime memory energy update_frequency acceptance_budget
uncertainty_quantification: inferential_unit uncertainty_sources method confidence_level interval acceptance_rule
distribution_shift: source_population target_population shift_family diagnostic acceptance_rule result
competing_mechanisms: candidate_explanation alternatives discrimination_test unresolved_alternatives result
network_dependence_control: inferential_unit dependence_structure method estimand result
robustness: perturbation_family locked_endpoint acceptance_rule worst_case_result
context_of_use: use population output decision_consequence prohibited_uses
biological_fidelity: observables scales reference_data metric acceptance_rule result
multiscale_consistency: scales coupling_interface conservation_or_consistency_rule test result
data_quality: source lineage exclusions missingness quality_checks result
entity_update: entity_id observation_time model_time update_method synchronization_error threshold
"""

# Claims and their ordered required blocks.
V2_CLAIMS_TEXT = """
bounded_predictive_performance: prediction context_of_use data_quality
clean_computational_reproduction: reproducible_compute
within_resource_reproduction: internal_reproduction data_quality
independent_study_replication: external_replication context_of_use data_quality
topology_specific_prediction: prediction topology_specificity uncertainty_quantification robustness context_of_use
assumption_conditional_direction: directed_identifiability uncertainty_quantification robustness context_of_use
local_observational_structure_function_association: structure_function_association network_dependence_control uncertainty_quantification robustness context_of_use data_quality
intervention_supported_effect: causal_intervention uncertainty_quantification robustness context_of_use data_quality
directed_topology_consistent_prediction: prediction internal_reproduction topology_specificity directed_identifiability uncertainty_quantification distribution_shift competing_mechanisms robustness context_of_use data_quality
complete_entity_specific_mouse_brain_digital_twin: prediction internal_reproduction external_replication topology_specificity directed_identifiability causal_intervention whole_brain_coverage independent_validation reproducible_compute entity_specificity operational_compute uncertainty_quantification distribution_shift competing_mechanisms network_dependence_control robustness context_of_use biological_fidelity multiscale_consistency data_quality entity_update
"""

# Claims of the prioritized first-version profile.
V1_CLAIMS_TEXT = """
predictive: prediction
computationally_reproducible: reproducible_compute
internally_reproduced: internal_reproduction
externally_replicated: external_replication
topology_specific: topology_specificity
directed: directed_identifiability
structure_function: structure_function_association
mechanistic: prediction internal_reproduction topology_specificity directed_identifiability
causal: causal_intervention
digital_twin: prediction internal_reproduction topology_specificity directed_identifiability causal_intervention whole_brain_coverage independent_validation reproducible_compute entity_specificity operational_compute
"""

# Prioritized rules (id, priority, quantifier, status, conclusion).
V1_RULES = (
    ("failed_block_veto", 100, "any", "failed", "blocked"),
    ("external_review_escalation", 90, "any", "requires_review", "needs_external_review"),
    ("missing_evidence_uncertainty", 80, "any", "unknown", "uncertain"),
    ("protocol_scope_boundary", 70, "any", "not_applicable", "out_of_scope"),
    ("all_requirements_satisfied", 0, "all", "passed", "supported"),
)


def _parse(text: str) -> dict[str, tuple[str, ...]]:
    rows = (line.split(":", 1) for line in text.strip().splitlines())
    return {name.strip(): tuple(rest.split()) for name, rest in rows}


@dataclass(frozen=True)
class Profile:
    """A claim vocabulary held on the driver; its size is known and small."""

    profile_id: str
    version: str
    claims: dict[str, tuple[str, ...]]
    blocks: dict[str, tuple[str, ...]]
    rules: tuple[tuple[str, int, str, str, str], ...] = ()
    source_hash: str = field(default="")

    def __post_init__(self):
        unknown = {b for req in self.claims.values() for b in req} - set(self.blocks)
        if unknown:
            raise ValueError(f"claims require undeclared blocks: {sorted(unknown)}")
        for claim, required in self.claims.items():
            if not required:
                raise ValueError(f"claim {claim} requires no block")
            if len(set(required)) != len(required):
                raise ValueError(f"claim {claim} repeats a required block")
        if not self.source_hash:
            text = json.dumps([self.profile_id, self.version, self.claims, self.blocks, self.rules])
            digest = hashlib.sha256(text.encode()).hexdigest()
            object.__setattr__(self, "source_hash", "sha256:" + digest)

    def relations(self) -> list[tuple[str, str, int]]:
        return [(c, b, i) for c, req in self.claims.items() for i, b in enumerate(req)]

    def block_index(self) -> dict[str, int]:
        return {b: i for i, b in enumerate(self.blocks)}

    def claims_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, i, len(req)) for i, (c, req) in enumerate(self.claims.items())]
        return spark.createDataFrame(rows, "claim string, claim_pos int, n_required int")

    def relations_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.relations(), "claim string, block string, pos int")

    def observations_df(self, spark: SparkSession) -> DataFrame:
        rows = [(b, f, i) for b, fields in self.blocks.items() for i, f in enumerate(fields)]
        return spark.createDataFrame(rows, "block string, field string, pos int")

    def rules_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.rules),
            "rule_id string, priority int, quantifier string, evidence_status string, conclusion string",
        )


def profile_v2() -> Profile:
    return Profile(
        "mouse_brain_claim_authorization", "2.0.0", _parse(V2_CLAIMS_TEXT), _parse(V2_BLOCKS_TEXT)
    )


def profile_v1() -> Profile:
    claims = _parse(V1_CLAIMS_TEXT)
    blocks = {b: () for req in claims.values() for b in req}
    return Profile("mouse_brain_claims", "1.1.0", claims, blocks, V1_RULES)


def profile_from_requirements(claims: dict[str, tuple[str, ...]], profile_id: str = "runtime_contract") -> Profile:
    """Runtime profile for custom contracts, with the standard rule ladder."""
    blocks = {b: () for req in claims.values() for b in req}
    return Profile(profile_id, "runtime", claims, blocks, V1_RULES)


def load_profile(path: str) -> Profile:
    """Read a profile mapping (YAML or JSON, one small driver-side file)."""
    with open(path, "rb") as handle:
        raw = handle.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        payload = yaml.safe_load(raw)
    else:
        payload = json.loads(raw)
    return profile_from_mapping(payload, "sha256:" + hashlib.sha256(raw).hexdigest())


def profile_from_mapping(payload: dict, source_hash: str = "") -> Profile:
    claims: dict[str, tuple[str, ...]] = {}
    for item in payload["claims"]:
        if item["id"] in claims:
            raise ValueError(f"duplicate claim {item['id']}")
        claims[item["id"]] = tuple(item["required_blocks"])
    declared = payload.get("evidence_blocks")
    if declared is None:
        blocks = {b: () for req in claims.values() for b in req}
    else:
        blocks = {b["id"]: tuple(b.get("required_observations_when_passed", ())) for b in declared}
        if len(blocks) != len(declared):
            raise ValueError("duplicate evidence block")
    rules = tuple(
        (r["id"], int(r["priority"]), r["quantifier"], r["evidence_status"], r["conclusion"])
        for r in sorted(payload.get("inference_rules", ()), key=lambda r: -int(r["priority"]))
    )
    return Profile(payload["profile_id"], str(payload["version"]), claims, blocks, rules, source_hash)
