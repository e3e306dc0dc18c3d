"""Rights as filters that come before everything else.

A policy is small and known to the driver, so what it says about a family of records becomes one
predicate over their columns, which reaches the scan.  Hidden records never become candidates, masks,
boundaries, edges or counts; nothing that follows can tell that they exist.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.context import QueryError

#: The closed catalog of capabilities, in its canonical order.
CAPABILITIES = (
    "project_read", "schema_read", "schema_manage", "history_space_read", "history_space_create", "history_space_transfer",
    "layer_read", "layer_write", "layer_manage", "assertion_read", "assertion_create", "assertion_correct", "assertion_retract",
    "event_read", "event_create", "event_correct", "event_retract", "event_span_close", "mask_read", "mask_create", "mask_retract",
    "event_mask_read", "event_mask_create", "event_mask_retract", "replacement_boundary_read", "replacement_boundary_create",
    "replacement_boundary_retract", "lifecycle_read", "source_read", "source_create", "source_supersede", "evidence_read",
    "evidence_create", "evidence_retract", "provenance_read", "provenance_create", "provenance_retract", "archive", "unarchive",
    "entity_create", "entity_read", "entity_reference", "entity_retire", "perspective_create", "perspective_read",
    "perspective_update", "perspective_use", "perspective_retire", "field_read", "field_write", "relationship_read",
    "relationship_create", "relationship_retract", "query_resolve", "query_search", "query_full_text", "query_explain",
    "query_graph_traverse", "query_aggregate", "raw_history_read", "admin_raw_read", "migration_plan", "migration_execute",
    "data_import", "data_export", "backup_create", "backup_restore", "purge", "job_read", "job_cancel", "job_manage",
    "security_policy_read", "security_policy_manage", "security_permission_history_read", "audit_read", "audit_export",
    "audit_configure", "storage_format_upgrade",
)

Truth = bool | Column


def both(a: Truth, b: Truth) -> Truth:
    if isinstance(a, bool):
        return b if a else False
    if isinstance(b, bool):
        return a if b else False
    return a & b


def either(a: Truth, b: Truth) -> Truth:
    if isinstance(a, bool):
        return True if a else b
    if isinstance(b, bool):
        return True if b else a
    return a | b


def opposite(a: Truth) -> Truth:
    return not a if isinstance(a, bool) else ~a


def column(a: Truth) -> Column:
    return F.lit(a) if isinstance(a, bool) else a


@dataclass(frozen=True)
class Scope:
    """What a rule or an assignment covers; a dimension that isn't given covers anything."""

    space: int | None = None
    layer: int | None = None
    record: tuple[str, int] | None = None  # family and id
    field: str | None = None
    relationship: str | None = None


@dataclass(frozen=True)
class Target:
    """The coordinates of records, as columns; a dimension that they lack is None and is never matched by a scope that names it."""

    space: Column | None = None
    layer: Column | None = None
    family: str | None = None
    record: Column | None = None
    field: Column | str | None = None
    relationship: Column | str | None = None

    def matches(self, scope: Scope) -> Truth:
        out: Truth = True
        family, record = scope.record or (None, None)
        if family is not None and family != self.family:
            return False
        for wanted, own in ((scope.space, self.space), (scope.layer, self.layer), (record, self.record), (scope.field, self.field), (scope.relationship, self.relationship)):
            if wanted is None:
                continue
            if own is None:
                return False
            out = both(out, own == wanted if isinstance(own, str) else F.coalesce(own == F.lit(wanted), F.lit(False)))
        return out


@dataclass(frozen=True)
class Rule:
    """Allows or denies a capability to a role or a principal within a scope."""

    effect: str
    capability: str
    subject: tuple[str, str] = ("role", "reader")  # role | principal, and its name
    scope: Scope = Scope()


@dataclass(frozen=True)
class Role:
    name: str
    bundle: tuple[tuple[str, str], ...] = ()  # capability, effect


@dataclass(frozen=True)
class Assignment:
    principal: str
    role: str
    scope: Scope = Scope()


@dataclass(frozen=True)
class Policy:
    """Principals with their state, roles with their bundles, assignments and rules, in force from a revision on."""

    principals: tuple[tuple[str, str], ...]  # name, active | disabled
    roles: tuple[Role, ...] = ()
    assignments: tuple[Assignment, ...] = ()
    rules: tuple[Rule, ...] = ()
    revision: int = 0

    def __post_init__(self):
        names, roles = [p for p, _ in self.principals], [r.name for r in self.roles]
        if len(set(names)) < len(names) or len(set(roles)) < len(roles) or len(set(self.assignments)) < len(self.assignments) or len(set(self.rules)) < len(self.rules):
            raise QueryError("principals, roles, assignments and rules: each once")
        if any(a.principal not in names or a.role not in roles for a in self.assignments):
            raise QueryError("an assignment of an unknown principal or role")
        if any(name not in (names if kind == "principal" else roles if kind == "role" else ()) for kind, name in (r.subject for r in self.rules)):
            raise QueryError("a rule for an unknown principal or role")
        grants = [(r.capability, r.effect) for r in self.rules] + [g for r in self.roles for g in r.bundle]
        if any(c not in CAPABILITIES or e not in ("allow", "deny") for c, e in grants):
            raise QueryError("a rule allows or denies a known capability")

    def allows(self, principal: str, capability: str) -> bool:
        """Rights on an operation without a target: scoped rules and assignments don't matter to it."""
        return authorize(self, principal, capability, Target()) is True

    def fingerprint(self, principal: str) -> str:
        """A digest of all capabilities that are effectively allowed on an operation without a target."""
        return hashlib.sha256(bytes(self.allows(principal, c) for c in CAPABILITIES)).hexdigest()

    # administration: each change is a new policy, in force from the next revision

    def _changed(self, **changes) -> Policy:
        return replace(self, revision=self.revision + 1, **changes)

    def with_principal(self, name: str, state: str = "active") -> Policy:
        """A new principal, or a new state of one; disabled ones stay disabled."""
        known = dict(self.principals)
        if state not in ("active", "disabled") or known.get(name) == "disabled":
            raise QueryError("a principal is active, then disabled")
        return self._changed(principals=tuple((known | {name: state}).items()))

    def with_role(self, role: Role) -> Policy:
        return self._changed(roles=(*(r for r in self.roles if r.name != role.name), role))

    def assigned(self, assignment: Assignment) -> Policy:
        return self._changed(assignments=(*self.assignments, assignment))

    def revoked(self, assignment: Assignment) -> Policy:
        if assignment not in self.assignments:
            raise QueryError("no such assignment")
        return self._changed(assignments=tuple(a for a in self.assignments if a != assignment))

    def with_rule(self, rule: Rule) -> Policy:
        return self._changed(rules=(*self.rules, rule))

    def without_rule(self, rule: Rule) -> Policy:
        if rule not in self.rules:
            raise QueryError("no such rule")
        return self._changed(rules=tuple(r for r in self.rules if r != rule))


def authorize(policy: Policy, principal: str, capability: str, target: Target) -> Truth:
    """Unknown and inactive principals have no right; any matching deny wins, else any matching allow; the default is deny."""
    if capability not in CAPABILITIES:
        raise QueryError(f"unknown capability {capability}")
    if dict(policy.principals).get(principal) != "active":
        return False
    held: dict[str, Truth] = {}
    for a in policy.assignments:
        if a.principal == principal:
            held[a.role] = either(held.get(a.role, False), target.matches(a.scope))
    sides: dict[str, Truth] = {"allow": False, "deny": False}
    for role in policy.roles:
        for c, effect in role.bundle:
            if c == capability:
                sides[effect] = either(sides[effect], held.get(role.name, False))
    for rule in policy.rules:
        kind, name = rule.subject
        if rule.capability == capability:
            own: Truth = held.get(name, False) if kind == "role" else name == principal
            sides[rule.effect] = either(sides[rule.effect], both(own, target.matches(rule.scope)))
    return both(sides["allow"], opposite(sides["deny"]))


def all_of(policy: Policy, principal: str, target: Target, capabilities: Iterable[str], fields: Iterable[Column | str] = ()) -> Truth:
    """Every capability on the records, and the right to read each of the fields."""
    out: Truth = True
    for c in capabilities:
        out = both(out, authorize(policy, principal, c, target))
    for f in fields:
        out = both(out, authorize(policy, principal, "field_read", replace(target, field=f)))
    return out


#: Family -> capability that reads its records; lifecycle records go with what they belong to.
READ = {
    "assertion": "assertion_read", "assertion_closure": "assertion_read", "assertion_retraction": "assertion_read",
    "mask": "mask_read", "mask_closure": "mask_read", "mask_retraction": "mask_read",
    "boundary": "replacement_boundary_read", "boundary_closure": "replacement_boundary_read", "boundary_retraction": "replacement_boundary_read",
    "event": "event_read", "event_span_closure": "event_read", "event_retraction": "event_read", "event_mask": "event_mask_read",
    "source": "source_read", "evidence": "evidence_read", "evidence_retraction": "evidence_read",
    "provenance": "provenance_read", "provenance_retraction": "provenance_read",
    "event_relation": "relationship_read", "event_relation_retraction": "relationship_read", "archive_transition": "lifecycle_read",
}
SOURCE_FIELDS = ("source.kind", "source.locator", "source.content_digest", "source.metadata")


@dataclass(frozen=True)
class Rights:
    """What a principal may see under a policy, as columns over the families' tables."""

    policy: Policy
    principal: str

    def may(self, capability: str) -> bool:
        return self.policy.allows(self.principal, capability)

    def demand(self, capability: str) -> None:
        """Operations other than resolution refuse a caller that lacks their right."""
        if not self.may(capability):
            raise QueryError(f"{self.principal} has no right to {capability}")

    def _records(self, target: Target, capability: str, fields: Iterable[Column | str]) -> Column:
        return column(all_of(self.policy, self.principal, target, ("history_space_read", "layer_read", capability), fields))

    def _resolving(self, right: Column) -> Column:
        """Without the right to resolve there are no candidates, and no error either."""
        return right if self.may("query_resolve") else F.lit(False)

    def assertions(self) -> Column:
        target = Target(F.col("space_id"), F.col("layer_id"), "assertion", F.col("assertion_id"))
        value = F.concat(F.lit("assertion.value/"), F.col("predicate_id").cast("string"))
        return self._resolving(self._records(target, "assertion_read", ("assertion.subject", "assertion.predicate", value, "assertion.polarity", "assertion.validity", "assertion.perspective", "assertion.epistemic_mode")))

    def masks(self) -> Column:
        return self._records(Target(F.col("space_id"), F.col("layer_id"), "mask", F.col("mask_id")), "mask_read", ("mask.selector", "mask.validity"))

    def boundaries(self) -> Column:
        target = Target(F.col("space_id"), F.col("layer_id"), "boundary", F.col("boundary_id"))
        return self._records(target, "replacement_boundary_read", ("replacement_boundary.subject", "replacement_boundary.predicate", "replacement_boundary.validity"))

    def events(self) -> Column:
        kind = F.col("kind")
        fields = ("event.kind", F.concat(F.lit("event.time/"), kind), F.concat(F.lit("event.participant/"), kind, F.lit("/"), F.col("role")))
        return self._records(Target(F.col("space_id"), F.col("layer_id"), "event", F.col("event_id")), "event_read", fields)

    def event_masks(self) -> Column:
        return self._records(Target(F.col("space_id"), F.col("layer_id"), "event_mask", F.col("event_mask_id")), "event_mask_read", ())

    def event_relations(self) -> Column:
        """Relations carry no space or layer of their own."""
        target = Target(family="event_relation", record=F.col("relation_id"), relationship=F.concat(F.lit("event/"), F.col("kind")))
        return column(authorize(self.policy, self.principal, "relationship_read", target))

    def provenance(self, space: int) -> Column:
        """Edges themselves, in the space of the query; their ends are another matter."""
        target = Target(space=F.lit(space), family="provenance", record=F.col("edge_id"), relationship=F.concat(F.lit("provenance/"), F.col("relation")))
        return column(all_of(self.policy, self.principal, target, ("relationship_read", "provenance_read")))

    def endpoints(self, family: str, key: str) -> Column:
        """Records that may be the end of an edge."""
        target = Target(F.col("space_id"), F.col("layer_id"), family, F.col(key))
        return self._records(target, READ[family], ())

    def sources(self) -> Column:
        return self._resolving(column(all_of(self.policy, self.principal, Target(family="source", record=F.col("source_id")), ("source_read",), SOURCE_FIELDS)))

    def evidence(self, space: int) -> Column:
        plain = Target(space=F.lit(space), family="evidence", record=F.col("evidence_id"))
        related = replace(plain, relationship=F.concat(F.lit("evidence/"), F.col("relation")))
        return column(both(all_of(self.policy, self.principal, related, ("evidence_read", "relationship_read")), authorize(self.policy, self.principal, "lifecycle_read", plain)))

    def evidence_targets(self) -> Column:
        target = Target(space=F.col("target_space_id"), family="assertion", record=F.col("target_id"))
        return column(all_of(self.policy, self.principal, target, ("history_space_read", "assertion_read")))

    def raw(self, family: str, space: str = "space_id", key: str = "id") -> Column:
        """Raw history: the right to it, to the space, and to the family."""
        target = Target(space=F.col(space), family=family, record=F.col(key))
        return column(all_of(self.policy, self.principal, target, ("history_space_read", "raw_history_read", READ[family])))

    def documents(self, family: str, key: str, fields: Iterable[str]) -> Column:
        """Search documents of records, where every searched field may be read."""
        target = Target(F.col("space_id"), F.col("layer_id"), family, F.col(key))
        return column(all_of(self.policy, self.principal, target, (READ[family],), [f"{family}.{f}" for f in fields]))


def readable(rows: DataFrame, right: Column | None) -> DataFrame:
    return rows if right is None else rows.filter(right)


def select_policy(versions: list[Policy], principal: str, snapshot: int, revision: int | None = None) -> Policy:
    """The policy in force now, or the one at an earlier revision, which needs the right to see the history of permissions now."""
    if not versions:
        raise QueryError("no policy")
    now = max(versions, key=lambda p: p.revision)
    if revision is None:
        return now
    if revision > snapshot:
        raise QueryError("that revision is after the snapshot")
    if not now.allows(principal, "security_permission_history_read"):
        raise QueryError("no right to earlier permissions")
    return at_revision(versions, revision)


def at_revision(versions: list[Policy], revision: int) -> Policy:
    """The policy in force at a revision."""
    known = [p for p in versions if p.revision <= revision]
    if not known:
        raise QueryError("no policy at that revision")
    return max(known, key=lambda p: p.revision)


def paired_worlds(observe, seen: object, seen_and_hidden: object) -> list[tuple[str, list, list]]:
    """Where two worlds that differ in hidden records only give different answers: (what, one, other).

    ``observe`` maps a world to named DataFrames; rows are compared whatever their order.
    """
    one, other = observe(seen), observe(seen_and_hidden)
    if set(one) != set(other):
        raise QueryError("the worlds are not observed alike")
    rows = {k: [sorted(map(repr, side[k].collect())) for side in (one, other)] for k in one}
    return [(k, a, b) for k, (a, b) in rows.items() if a != b]
