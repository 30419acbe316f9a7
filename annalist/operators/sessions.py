"""Sessions of work by hand: contracts of their journal payloads, acts on groups of mentions, runs to the next gate, bundles,
inputs of all records, and the doctor's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import SHA256, TOKEN, sha256, zoned_time
from annalist.operators.planning import build

#: What a reference to a sealed object and its sealed context hold.
REF = ["v", "role", "sha256", "cipher_sha256", "aad"]
EDITOR_AAD = ["domain", "v", "workspace", "profile", "graph", "record", "phase", "object_id", "session_id", "revision", "key_id", "store_id"]
REGISTER_AAD = ["domain", "v", "workspace", "profile", "graph", "registry_id", "key_id", "role", "record", "version", "parent", "operation"]
MARKER = ["domain", "v", "record", "profile", "graph", "operation", "actor", "actor_state", "at", "basis", "volltext_gelesen", "counts"]
COUNTS = ["total", "worked", "open", "excluded", "added"]
#: Roles of sealed objects, and what each phase of editing writes.
EDITOR_ROLES = {"pii.mark": "pii.spans", "pseudonymise": "transcript.pseudonymised.draft", "pseudonymisation.cases": "pseudonymisation.cases"}
REGISTER, RESOLUTION, FINAL, REPORT = "pseudonymisation.registry", "pseudonymisation.resolution", "transcript.pseudonymised.final", "replacement.report"
#: What a phase is based on, and what it refers to.
EDITOR_BASIS = ["transcript.confirmed", "transcript.revision", "pseudonymisation.policy"]
RESOLVE_BASIS = [*EDITOR_BASIS, "pii.spans", "transcript.pseudonymised.draft", "pseudonymisation.cases"]
FINALISE_BASIS = [*RESOLVE_BASIS, REGISTER, RESOLUTION]
REVIEW_BASIS = [*FINALISE_BASIS, FINAL, REPORT]
PHASES = {"resolve": (RESOLVE_BASIS, [RESOLUTION]), "finalise": (FINALISE_BASIS, [FINAL, REPORT]), "review": (REVIEW_BASIS, [])}
#: The areas a doctor looks at, the gravest first, and the status that a finding in each gives.
AREAS = {"structure": "STOP", "journal": "STOP", "graph": "CONFIG", "egress": "STOP", "ledger": "STOP", "store": "STOP", "metadata": "ACTION_NEEDED"}
STATES = ("OPEN", "RESOLVED", "DEFERRED")
_OPAQUE, _UTC = r"^[0-9a-f]{32}\z", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?\+00:00\z"


def manual_context(record: Column, profile: Column, profiles: dict[str, tuple[str, int]]) -> Column:
    """Whether a record's id is one of its profile (name: prefix, digits), or of any profile where that is null. False for
    null ids and unknown profiles."""
    fits = [(F.coalesce(profile == name, profile.isNull()) & record.rlike(rf"^{prefix}-[0-9]{{{digits}}}\z")) for name, (prefix, digits) in profiles.items()]
    return F.coalesce(F.greatest(F.lit(False), *fits), F.lit(False))


class _Json:
    """Typed looks into a variant at a path; null wherever something is missing or of another type."""

    def __init__(self, v: Column, path: str = "$") -> None:
        self.v, self.path = v, path

    def at(self, path: str) -> _Json:
        return _Json(self.v, f"{self.path}.{path}")

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.v, self.path, kind)

    def kind(self) -> Column:
        return F.schema_of_variant(self.get("variant"))

    def text(self) -> Column:
        return F.when(self.kind() == "STRING", self.get("string"))

    def whole(self) -> Column:
        return F.when(self.kind() == "BIGINT", self.get("bigint"))

    def null(self) -> Column:
        return self.kind() == "VOID"

    def true(self) -> Column:
        return (self.kind() == "BOOLEAN") & self.get("boolean")

    def like(self, pattern: str) -> Column:
        return self.text().rlike(pattern)

    def map(self) -> Column:
        return F.when(self.kind().startswith("OBJECT<"), self.get("map<string,variant>"))

    def keys(self, wanted: Column | list[str]) -> Column:
        """Whether the object has exactly these keys."""
        want = F.array(*map(F.lit, sorted(wanted))).cast("array<string>") if isinstance(wanted, list) else F.array_sort(wanted)
        return F.array_sort(F.map_keys(self.map())) == want

    def same(self) -> Column:
        """Text to compare objects by: keys in order."""
        return F.to_json(F.array_sort(F.map_entries(self.get("map<string,string>"))))


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that doesn't hold; a rule that can't be told doesn't."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def _all(*rules: Column) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & F.coalesce(r, F.lit(False))
    return out


def _head(ref: _Json, aad: list[str], domain: str) -> list[Column]:
    a = ref.at("aad")
    return [ref.keys(REF), ref.at("v").whole() == 1, ref.at("sha256").like(SHA256), ref.at("cipher_sha256").like(SHA256), a.keys(aad), a.at("domain").text() == domain, a.at("v").whole() == 1,
            a.at("workspace").like(SHA256), a.at("graph").like(SHA256)]


def _editor_ref(ref: _Json, profiles: dict) -> Column:
    a = ref.at("aad")
    return _all(*_head(ref, EDITOR_AAD, "annalist:p4b:protected"), ref.at("role").text().isin([*EDITOR_ROLES.values(), "editor", "plan"]), a.at("phase").text().isin(list(EDITOR_ROLES)),
                a.at("profile").text().isin(list(profiles)), manual_context(a.at("record").text(), a.at("profile").text(), profiles), *[a.at(n).like(_OPAQUE) for n in ("object_id", "session_id", "key_id", "store_id")],
                a.at("revision").whole() >= 1)


def _register_ref(ref: _Json, profiles: dict) -> Column:
    a, role = ref.at("aad"), ref.at("role").text()
    owner = F.when(role == REGISTER, a.at("record").null()).otherwise(manual_context(a.at("record").text(), a.at("profile").text(), profiles))
    return _all(*_head(ref, REGISTER_AAD, "annalist:p4c:protected"), role.isin(REGISTER, RESOLUTION, FINAL, REPORT), a.at("role").text() == role, a.at("profile").text().isin(list(profiles)),
                *[a.at(n).like(_OPAQUE) for n in ("registry_id", "key_id", "operation")], a.at("version").whole() > 0, a.at("parent").null() | a.at("parent").like(SHA256), owner,
                (role == FINAL) | (ref.at("sha256").text() == ref.at("cipher_sha256").text()))


def _basis(basis: _Json, wanted: Column) -> Column:
    """Exactly the wanted roles, each with a digest and a number from 1."""
    pair = lambda x: _all(F.size(F.try_variant_get(x, "$", "array<variant>")) == 2, _Json(x, "$[0]").like(SHA256), _Json(x, "$[1]").whole() > 0)
    return _all(basis.keys(wanted), F.forall(F.map_values(basis.map()), pair))


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def editor_problem(kind: Column, v: Column, record: Column, profiles: dict[str, tuple[str, int]]) -> Column:
    """The first rule that a payload of an editing session breaks; null if none. Kinds: p4b.policy, p4b.checkpoint,
    p4b.prepared, p4b.completed; others, and payloads that are no objects (null too), break ``kind`` and ``keys``. ``v``: the
    payload as a variant, a column of its own, so that it is parsed once."""
    p = _Json(v)
    ref, plan, phase = p.at("ref"), p.at("plan"), p.at("ref").at("aad").at("phase").text()
    basis = F.concat(_words(EDITOR_BASIS), F.when(phase != "pii.mark", _words(["pii.spans"])).otherwise(_words([])), F.when(phase == "pseudonymisation.cases", _words(["transcript.pseudonymised.draft"])).otherwise(_words([])))
    first = [("record", manual_context(record, F.lit(None).cast("string"), profiles)), ("version", p.at("v").whole() == 1)]
    keyed = lambda *names: [("keys", p.keys(["v", *names])), *first]
    body = [("ref", _editor_ref(ref, profiles)), ("ref_record", ref.at("aad").at("record").text() == record), ("actor", p.at("actor").like(TOKEN)), ("actor_state", p.at("actor_state").like(SHA256)), ("basis", _basis(p.at("basis"), basis))]
    previous = p.at("previous")
    checkpoint = [*keyed("ref", "basis", "actor", "actor_state", "previous"), *body, ("role", (ref.at("role").text() == "editor") & (phase != "pseudonymise")), ("previous", previous.null() | previous.like(SHA256)),
                  ("first", previous.null() == (ref.at("aad").at("revision").whole() == 1))]
    writes = F.coalesce(*[F.when(phase == k, F.lit(v)) for k, v in EDITOR_ROLES.items()])
    but_id = lambda r: F.to_json(F.array_sort(F.map_entries(F.map_filter(r.at("aad").get("map<string,string>"), lambda k, _: k != "object_id"))))
    prepared = [*keyed("ref", "plan", "basis", "actor", "actor_state", "checkpoint", "at"), *body, ("role", ref.at("role").text() == writes), ("plan", _editor_ref(plan, profiles) & (plan.at("role").text() == "plan")),
                ("plan_context", but_id(ref) == but_id(plan)), ("checkpoint", F.when(phase == "pseudonymise", p.at("checkpoint").null()).otherwise(p.at("checkpoint").like(SHA256))), ("at", p.at("at").like(_UTC))]
    policy = [*keyed("profile", "graph", "sha256"), ("profile", p.at("profile").text().isin(list(profiles)) & manual_context(record, p.at("profile").text(), profiles)), ("graph", p.at("graph").like(SHA256)), ("sha256", p.at("sha256").like(SHA256))]
    completed = [*keyed("prepared_sha256"), ("prepared", p.at("prepared_sha256").like(SHA256))]
    told = F.when(kind == "p4b.policy", _first(policy)).when(kind == "p4b.checkpoint", _first(checkpoint)).when(kind == "p4b.prepared", _first(prepared)).when(kind == "p4b.completed", _first(completed))
    return F.when(~F.coalesce(kind.isin("p4b.policy", "p4b.checkpoint", "p4b.prepared", "p4b.completed"), F.lit(False)), "kind").otherwise(told)


def register_problem(kind: Column, v: Column, record: Column, profiles: dict[str, tuple[str, int]]) -> Column:
    """The first rule that a payload of the corpus register breaks; null if none. Kinds: p4c.init.prepared, p4c.initialised,
    p4c.prepared, p4c.completed, p4c.aborted; others break ``kind``. ``v`` as in ``editor_problem``."""
    p = _Json(v)
    phase, after, before, refs, marker = p.at("phase").text(), p.at("registry_after"), p.at("registry_before"), p.at("refs"), p.at("marker")
    by_phase = lambda n: F.coalesce(*[F.when(phase == k, _words(v[n])) for k, v in PHASES.items()])
    version, at = ("version", p.at("v").whole() == 1), ("at", zoned_time(p.at("at").text()).isNotNull())
    whose = ("record", manual_context(record, F.lit(None).cast("string"), profiles))
    ref = p.at("ref")
    opened = [("keys", p.keys(["v", "ref", "at"])), version, ("record", record.isNull()), ("ref", _register_ref(ref, profiles)), ("first", (ref.at("role").text() == REGISTER) & (ref.at("aad").at("version").whole() == 1) & ref.at("aad").at("parent").null()), at]
    closed = [("keys", p.keys(["v", "prepared_sha256"])), version, whose, ("prepared", p.at("prepared_sha256").like(SHA256))]
    a, b, op = after.at("aad"), before.at("aad"), p.at("operation").text()
    registers = lambda r: _register_ref(r, profiles) & (r.at("role").text() == REGISTER)
    unchanged = after.same() == before.same()
    moves = (phase == "finalise") & (a.at("parent").text() == before.at("sha256").text()) & (a.at("version").whole() == b.at("version").whole() + 1) & (a.at("operation").text() == op)

    def named(x: Column) -> Column:
        r = _Json(x["value"])
        c = r.at("aad")
        return _all(_register_ref(r, profiles), r.at("role").text() == x["key"], c.at("record").text() == record, c.at("operation").text() == op,
                    *[c.at(k).text() == a.at(k).text() for k in ("workspace", "profile", "graph", "registry_id", "key_id")])

    count = lambda n: marker.at(f"counts.{n}").whole()
    told = _all(marker.keys(MARKER), marker.at("domain").text() == "annalist:p4c:confirmation", marker.at("v").whole() == 1, marker.at("record").text() == record, marker.at("profile").text().isin(list(profiles)),
                manual_context(record, marker.at("profile").text(), profiles), marker.at("graph").text() == a.at("graph").text(), marker.at("volltext_gelesen").true(),
                marker.at("basis").same() == p.at("basis").same(), marker.at("counts").keys(COUNTS), *[count(n) >= 0 for n in COUNTS], count("open") == 0, *[marker.at(k).text() == p.at(k).text() for k in ("operation", "actor", "actor_state", "at")])
    prepared = [("keys", p.keys(["v", "phase", "operation", "actor", "actor_state", "at", "basis", "registry_before", "registry_after", "refs", "marker"])), version, whose, ("phase", phase.isin(list(PHASES))), ("operation", p.at("operation").like(_OPAQUE)),
                ("actor", p.at("actor").like(TOKEN)), ("actor_state", p.at("actor_state").like(SHA256)), at, ("basis", _basis(p.at("basis"), by_phase(0))), ("registry", registers(before) & registers(after)),
                ("registry_id", a.at("registry_id").text() == b.at("registry_id").text()), ("successor", unchanged | moves), ("refs", refs.keys(by_phase(1))), ("ref", F.forall(F.map_entries(refs.map()), named)), ("marker", F.when(phase == "review", told).otherwise(marker.null()))]
    kinds = {"p4c.init.prepared": opened, "p4c.initialised": opened, "p4c.prepared": prepared, "p4c.completed": closed, "p4c.aborted": closed}
    known = F.coalesce(kind.isin(list(kinds)), F.lit(False))
    out = F.when(~known, "kind")
    for k, rules in kinds.items():
        out = out.when(kind == k, _first(rules))
    return out


def merge(groups: DataFrame, acts: DataFrame) -> DataFrame:
    """act, problem, group_id, members: what each merge of groups makes; a refused one makes nothing and names its problem.

    few (less than two groups), repeated (a group named twice), unknown (no such group), kinds (several types or scopes).
    The new group's id is the digest of its members, so reruns agree. Groups: group_id, entity_type, scope, members (array);
    acts: act, group_ids (array). One join by group and one aggregation by act.
    """
    named = acts.select("act", F.explode_outer("group_ids").alias("group_id"))
    j = named.join(groups.select("group_id", "entity_type", "scope", "members", F.lit(True).alias("there")), "group_id", "left")
    g = j.groupBy("act").agg(
        F.count("group_id").alias("n"), F.count_distinct("group_id").alias("different"), F.count("there").alias("found"), F.count_distinct(F.struct("entity_type", "scope")).alias("kinds"),
        F.array_sort(F.flatten(F.collect_list("members"))).alias("all"))
    problem = F.when(F.col("n") < 2, "few").when(F.col("different") < F.col("n"), "repeated").when(F.col("found") < F.col("n"), "unknown").when(F.col("kinds") > 1, "kinds")
    members = F.when(problem.isNull(), F.col("all"))
    return g.select("act", problem.alias("problem"), sha256(F.array_join(members.cast("array<string>"), ",")).alias("group_id"), members.alias("members"))


def split(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """group_id, problem, parts: how many new groups a split makes of each group that is split.

    unknown (no such group), few (less than two parts), repeated (a member in two places), cover (members missing or
    foreign). Groups as in ``merge``; parts: group_id, part, member. One join by group.
    """
    listed = parts.groupBy("group_id").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"), F.array_sort(F.collect_set("member")).alias("flat"))
    j = listed.join(groups.select("group_id", F.array_sort(F.array_distinct("members")).alias("members")), "group_id", "left")
    problem = F.when(F.col("members").isNull(), "unknown").when(F.col("parts") < 2, "few").when(F.size("flat") < F.col("n"), "repeated").when(F.col("flat") != F.col("members"), "cover")
    return j.select("group_id", problem.alias("problem"), F.when(problem.isNull(), F.col("parts")).otherwise(F.lit(0)).alias("parts"))


def exclude(groups: DataFrame, mentions: DataFrame) -> DataFrame:
    """The groups without the excluded mentions: those that lose one are OPEN again, those that lose all are gone.

    Groups: group_id, state, members, and more columns that stay; mentions: group_id, member.
    """
    lost = mentions.groupBy("group_id").agg(F.collect_set("member").alias("lost"))
    j = groups.join(lost, "group_id", "left").withColumn("left_over", F.array_except("members", F.coalesce("lost", F.slice("members", 1, 0))))
    j = j.withColumn("touched", F.size("left_over") < F.size(F.array_distinct("members"))).where(~F.col("touched") | (F.size("left_over") > 0))
    new = {"state": F.when(F.col("touched"), "OPEN").otherwise(F.col("state")), "members": F.when(F.col("touched"), F.col("left_over")).otherwise(F.col("members"))}
    return j.withColumns(new).drop("lost", "left_over", "touched")


def set_state(groups: DataFrame, acts: DataFrame) -> DataFrame:
    """The groups with the last valid state that acts (group_id, seq, state) give them; other states change nothing."""
    last = acts.where(F.col("state").isin(*STATES)).groupBy("group_id").agg(F.max_by("state", "seq").alias("new"))
    return groups.join(last, "group_id", "left").withColumn("state", F.coalesce("new", "state")).drop("new")


def run_on(have: DataFrame, profile: str, handlers: dict[str, tuple[str, bool]], confirm: bool = False) -> DataFrame:
    """record_id, executed, gates, inputs, deferred, unbuilt, failure: how far a record goes until something halts it.

    Runs what can run (a RUN handler, cheap or ``confirm``), each step once; a step that fails, or that leaves no artifact,
    stops the record, and no waiting steps are told then. Else the waiting ones: gates, inputs, dear steps and steps
    without handler. Handlers: step to (mode RUN, GATE or INPUT, cheap). ``have``: record_id, artifacts, failing (steps
    that raise), silent (steps that claim and leave nothing). The graph is in topological order, so one fold over it is the
    whole loop: no step makes an earlier one eligible.
    """
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    told = lambda s: handlers.get(s.name, ("NONE", False))
    graph = F.array(*[F.struct(F.lit(s.name).alias("step"), text(s.requires).alias("requires"), text(s.produces).alias("produces"), F.lit(s.gate).alias("gate"), F.lit(told(s)[0]).alias("mode"), F.lit(told(s)[1]).alias("cheap")) for s in build(profile)])
    none = F.array().cast("array<string>")
    start = F.struct(F.col("artifacts").cast("array<string>").alias("have"), none.alias("executed"), F.lit(None).cast("string").alias("failure"))
    waits = lambda s, there: (F.size(F.array_except(s["produces"], there)) > 0) & (F.size(F.array_except(s["requires"], there)) == 0)

    def step(state, s):
        runs = state["failure"].isNull() & waits(s, state["have"]) & (s["mode"] == "RUN") & (s["cheap"] | F.lit(confirm))
        fails, silent = runs & F.array_contains("failing", s["step"]), runs & F.array_contains("silent", s["step"])
        done = runs & ~fails
        return F.struct(
            F.when(done & ~silent, F.array_union(state["have"], s["produces"])).otherwise(state["have"]).alias("have"), F.when(done, F.concat(state["executed"], F.array(s["step"]))).otherwise(state["executed"]).alias("executed"),
            F.when(fails, F.concat(F.lit("failed: "), s["step"])).when(silent, F.concat(F.lit("unproven: "), s["step"])).otherwise(state["failure"]).alias("failure"))

    done = have.withColumn("s", F.aggregate(graph, start, step))
    halted = lambda keep: F.array_join(F.transform(F.filter(graph, lambda s: F.col("s.failure").isNull() & waits(s, F.col("s.have")) & keep(s)), lambda s: s["step"]), ",")
    return done.select(
        "record_id", F.array_join("s.executed", ",").alias("executed"), halted(lambda s: s["gate"] & (s["mode"] != "NONE")).alias("gates"), halted(lambda s: s["mode"] == "INPUT").alias("inputs"),
        halted(lambda s: (s["mode"] == "RUN") & ~s["cheap"]).alias("deferred"), halted(lambda s: s["mode"] == "NONE").alias("unbuilt"), F.col("s.failure").alias("failure"))


def export_bundle(chain: DataFrame, drafts: DataFrame, production: Column) -> DataFrame:
    """record_id, problem, bundle_sha256, open: the canonical bundle of every record's chain, or why there is none.

    A chain's own problem first; in production, ``moved`` (the metadata's input is another by now) and ``open`` (required
    fields are missing). Chain: as ``recovery.bundle`` returns it; drafts: record_id, actor, input_sha256, now_sha256, fields
    (map), required (array). A record without draft has the problem ``draft``.
    """
    j = chain.join(drafts.withColumn("there", F.lit(True)).hint("merge"), "record_id", "left").withColumn("open", F.array_sort(F.array_except("required", F.map_keys("fields"))))
    problem = F.coalesce("problem", F.when(F.col("there").isNull(), "draft"), F.when(production & ~F.col("input_sha256").eqNullSafe(F.col("now_sha256")), "moved"), F.when(production & (F.size("open") > 0), "open"))
    fields = F.map_from_entries(F.array_sort(F.map_entries("fields")))
    catalog = F.struct(F.struct(F.col("abstract_draft").alias("draft")).alias("abstract"), F.col("adjudicated"), F.struct(F.col("metadata_draft").alias("draft"), fields.alias("fields"), F.col("open").alias("open_requirements")).alias("metadata"))
    whole = F.to_json(F.struct(F.lit(False).alias("analysis_included"), catalog.alias("catalog"), "record_id", F.struct("actor").alias("release"), F.lit("annalist.export.bundle").alias("schema")), {"ignoreNullFields": "false"})
    return j.select("record_id", problem.alias("problem"), F.when(problem.isNull(), F.sha2(whole, 256)).alias("bundle_sha256"), F.coalesce(F.array_join("open", ","), F.lit("")).alias("open"))


def side_inputs(records: DataFrame, timeline: DataFrame, roles: list[str]) -> DataFrame:
    """records with a struct (sha256, seq) for each role: the last of its inputs in the whole journal, which holds for all
    records, null if there is none. Timeline: role, seq, sha256. One row goes to the tasks, whatever the journal's size."""
    last = [F.max_by(F.struct("sha256", "seq"), F.when(F.col("role") == r, F.col("seq"))).alias(r) for r in roles]
    return records.crossJoin(F.broadcast(timeline.where(F.col("role").isin(roles)).agg(*last)))


def doctor(findings: DataFrame, first: int = 3) -> DataFrame:
    """area, rank, status, findings, shown: how many findings each area has, and the first of them by record and text.

    Findings: area, record_id, text. Areas without findings have no row; unknown areas are STOP and come last. The first
    findings are chosen with a limit in each task before the shuffle.
    """
    names = F.array(*map(F.lit, AREAS))
    at = F.array_position(names, F.col("area"))
    f = findings.withColumn("rank", F.when(at > 0, at).otherwise(len(AREAS) + 1).cast("int"))
    counts = f.groupBy("area", "rank").agg(F.count("*").alias("findings"))
    order = W.partitionBy("area").orderBy("record_id", "text")
    top = f.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    shown = top.groupBy("area").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "; ").alias("shown"))
    status = F.coalesce(*[F.when(F.col("area") == a, F.lit(s)) for a, s in AREAS.items()], F.lit("STOP"))
    return counts.join(shown, "area").select("area", "rank", status.alias("status"), "findings", "shown")
