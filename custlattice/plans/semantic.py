"""Named metrics: a model of tables, dimensions, measures and relationships, resolved to groupBy/agg.

A model is loaded from a plain mapping (or a YAML file with the same shape). Measure expressions
are SQL aggregates over one table. A request may combine measures of several tables by dimensions
they share through declared relationships: every table is aggregated on its own before
the results are joined, so no measure is multiplied by a join. Relationships are followed over any number of hops, but only
towards one row; a dimension that lies across a one-to-many hop, or at the end of two equally short paths, is refused.
A measure that names its ``parts`` is added up per key before the first join.

``problems`` holds a model against tables before anything runs: Spark's parser and analyser read every expression, and what they refuse is
reported with the name of the term.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    name: str
    expr: str
    synonyms: tuple[str, ...] = ()
    #: measures only: name -> (aggregate over rows, how its values of several groups become one); ``expr`` is then written over these names
    parts: dict[str, tuple[str, str]] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class ModelTable:
    name: str
    dimensions: dict[str, Term]
    measures: dict[str, Term]


@dataclass(frozen=True)
class Relationship:
    """Rows of ``table`` and ``target`` with the same ``key``: ``many_to_one`` (a row points to at most one), ``one_to_one`` or ``one_to_many``."""

    table: str
    key: str
    target: str
    cardinality: str = "many_to_one"

    def __post_init__(self):
        if self.cardinality not in ("many_to_one", "one_to_one", "one_to_many"):
            raise ValueError(f"{self.table} to {self.target}: unknown cardinality {self.cardinality!r}")

    def turned(self) -> Relationship:
        other = {"many_to_one": "one_to_many", "one_to_many": "many_to_one"}.get(self.cardinality, self.cardinality)
        return Relationship(self.target, self.key, self.table, other)


@dataclass(frozen=True)
class SemanticModel:
    tables: dict[str, ModelTable]
    relationships: tuple[Relationship, ...] = field(default=())

    @classmethod
    def from_dict(cls, spec: dict) -> SemanticModel:
        """Read ``{"tables": [{"name", "dimensions", "measures", "time_dimensions"}], "relationships"}``."""

        def terms(items):
            return {
                i["name"].lower(): Term(i["name"].lower(), _spark_sql(i["expr"]), tuple(i.get("synonyms", ())), i.get("parts", {}))
                for i in items
            }

        tables = {}
        for t in spec["tables"]:
            dims = [*t.get("dimensions", ()), *t.get("time_dimensions", ())]
            name = t["name"].lower()
            tables[name] = ModelTable(name, terms(dims), terms(t.get("measures", ())))
        links = tuple(Relationship(**r) for r in spec.get("relationships", ()))
        return cls(tables, links)

    @classmethod
    def from_yaml(cls, path: str) -> SemanticModel:
        """A file with the mapping of ``from_dict``."""
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading a YAML model needs PyYAML; use from_dict otherwise") from e
        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f))

    def _find(self, name: str, kind: str, tables) -> tuple[str, Term]:
        """Resolve ``name`` or ``table.name`` or a synonym."""
        wanted = name.lower()
        scope, _, bare = wanted.rpartition(".")
        found = [
            (t, term)
            for t in tables
            if not scope or scope == t
            for term in getattr(self.tables[t], kind).values()
            if (bare or wanted) == term.name or wanted in (s.lower() for s in term.synonyms)
        ]
        if not found and set(tables) != set(self.tables) and any(self._has(t, kind, name) for t in self.tables):
            raise ValueError(f"{name!r} cannot be reached from {next(iter(tables))} by one path that keeps its rows single")
        if not found:
            raise KeyError(f"no {kind[:-1]} named {name!r}")
        return found[0]

    def _has(self, table: str, kind: str, name: str) -> bool:
        scope, _, bare = name.lower().rpartition(".")
        terms = getattr(self.tables[table], kind).values()
        return scope in ("", table) and any(bare == t.name or bare in (s.lower() for s in t.synonyms) for t in terms)

    def paths(self, table: str) -> dict[str, list[Relationship]]:
        """The tables of which a row of ``table`` has at most one row, nearest first, with the hops that lead there.

        A table at the end of several equally short paths is left out, and nothing is reached through it.
        """
        hops = [r for r in (*self.relationships, *[r.turned() for r in self.relationships]) if r.cardinality != "one_to_many"]
        known: dict[str, list[Relationship]] = {table: []}
        unclear: set[str] = set()
        edge = [table]
        while edge:
            found: dict[str, list[list[Relationship]]] = {}
            for t in edge:
                for r in hops:
                    if r.table == t and r.target not in known and r.target not in unclear:
                        found.setdefault(r.target, []).append([*known[t], r])
            unclear |= {t for t, ways in found.items() if len(ways) > 1}
            edge = [t for t in found if t not in unclear]
            known |= {t: found[t][0] for t in edge}
        return known

    def _reachable(self, table: str) -> list[str]:
        return list(self.paths(table))


#: Functions that expressions of a model may call: their values depend on the rows alone, not on the run.
FUNCTIONS = frozenset(
    "abs any_value avg ceil coalesce concat count count_if date_trunc datediff floor greatest if ifnull least lower max max_by median min min_by "
    "month nullif percentile quarter rint round stddev substring sum trim upper variance year".split()
)


def functions_of(spark: SparkSession, expr: str) -> set[str]:
    """Names of the functions that ``expr`` calls, as Spark's parser reads it; a subquery counts as function ``subquery``."""
    found, nodes = set(), [spark._jsparkSession.sessionState().sqlParser().parseExpression(expr)]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            found.add(node.nameParts().mkString(".").lower())
        elif "Subquery" in kind or kind == "Exists":
            found.add("subquery")
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def problems(model: SemanticModel, frames: dict[str, DataFrame], functions: frozenset[str] = FUNCTIONS) -> list[str]:
    """What keeps ``model`` from being used on ``frames``, one line each, empty if nothing: tables that are not there, expressions that do not parse
    or call other functions than ``functions``, unknown columns, dimensions that aggregate and measures that do not, keys that a side
    of a relationship lacks. Expressions are analysed, no row is read."""
    out = []

    def judged(what: str, expr: str, use) -> None:
        try:
            others = sorted(functions_of(frame.sparkSession, expr) - functions)
            out.extend(f"{what}: function {name} is not allowed" for name in others)
            if not others:
                use(F.expr(expr)).schema  # noqa: B018
        except (AnalysisException, ParseException) as e:
            named = (e.getMessageParameters() or {}).get("objectName")
            out.append(f"{what}: {e.getCondition()}" + (f" {named}" if named else ""))
        except Exception as e:  # the parser itself, called through the gateway, raises what it throws in Java
            if "ParseException" not in str(e):
                raise
            out.append(f"{what}: PARSE_SYNTAX_ERROR")

    for name, table in model.tables.items():
        if name not in frames:
            out.append(f"{name}: no such table")
            continue
        frame = frames[name]
        for term in table.dimensions.values():
            judged(f"{name}.{term.name}", term.expr, lambda c: frame.groupBy(c.alias("of")).count())
        for term in table.measures.values():
            what = f"{name}.{term.name}"
            if not term.parts:
                judged(what, term.expr, lambda c: frame.agg(c.alias("of")))
                continue
            before = len(out)
            for part, (expr, merge) in term.parts.items():
                judged(f"{what} ({part})", expr, lambda c: frame.agg(c.alias("of")))
                if merge not in functions:
                    out.append(f"{what} ({part}): function {merge} is not allowed")
            if len(out) == before:
                summed = frame.agg(*[F.expr(expr).alias(part) for part, (expr, _) in term.parts.items()])
                judged(what, term.expr, lambda c: summed.select(c.alias("of")))
    for r in model.relationships:
        for side in (r.table, r.target):
            if side not in model.tables:
                out.append(f"{r.table} to {r.target}: no table {side}")
            elif side in frames and r.key.lower() not in (c.lower() for c in frames[side].columns):
                out.append(f"{r.table} to {r.target}: {side} has no column {r.key}")
    return out


def _spark_sql(expr: str) -> str:
    """The warehouse's FLOAT is a 64-bit number."""
    return re.sub(r"::\s*FLOAT\b", "::DOUBLE", expr, flags=re.IGNORECASE)


def metrics(
    model: SemanticModel, frames: dict[str, DataFrame], names: list[str], by: list[str] = (),
    where: Column | None = None, order: list[Column] = (), limit: int | None = None,
) -> DataFrame:
    """Measures ``names`` grouped by dimensions ``by``. ``where`` filters on dimension names."""
    per_table: dict[str, list[Term]] = {}
    for n in names:
        table, term = model._find(n, "measures", model.tables)
        per_table.setdefault(table, []).append(term)
    results = [_one_table(model, frames, t, terms, list(by), where) for t, terms in per_table.items()]
    labels = _labels(model, next(iter(per_table)), list(by))
    out = reduce(lambda a, b: _same_groups(a, b, labels), results)
    out = out.select(*labels, *[t.name for terms in per_table.values() for t in terms])
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def _labels(model, table, by) -> list[str]:
    return [model._find(d, "dimensions", model._reachable(table))[1].name for d in by]


def _one_table(model, frames, table, terms, by, where) -> DataFrame:
    paths = {t: way for t, way in model.paths(table).items() if all(x in frames for x in (t, *[r.target for r in way]))}
    # all dimensions in reach that this request needs: its own, and those named in the filter
    dims: dict[str, tuple[str, Term]] = {}
    for t in paths:
        for d in model.tables[t].dimensions.values():
            dims.setdefault(d.name, (t, d))
    wanted = [model._find(d, "dimensions", paths) for d in by]
    needed = {d.name: (t, d) for t, d in wanted}
    if where is not None:
        needed = dims | needed
    fact = frames[table].withColumns({f"dim_{n}": F.expr(d.expr) for n, (t, d) in needed.items() if t == table})
    hops = {r.target: r for t, _ in needed.values() for r in paths[t]}
    first_keys = sorted({r.key for r in hops.values() if r.table == table})
    parts = {n: p for t in terms for n, p in t.parts.items()}
    reduced = bool(first_keys) and all(t.parts for t in terms)
    if reduced:  # one row per key and own dimension meets the other tables
        fact = fact.groupBy(*first_keys, *[c for c in fact.columns if c.startswith("dim_")]).agg(*[F.expr(p).alias(f"part_{n}") for n, (p, _) in parts.items()])
    for target in (t for t in paths if t in hops):  # nearest first, so that a hop's key is there
        hop = hops[target]
        key = hop.key if hop.table == table else f"key_{hop.table}_{hop.key}"
        onward = sorted({r.key for r in hops.values() if r.table == target})
        side = frames[target].select(
            F.col(hop.key).alias(key), *[F.col(k).alias(f"key_{target}_{k}") for k in onward],
            *[F.expr(d.expr).alias(f"dim_{n}") for n, (t, d) in needed.items() if t == target],
        )
        fact = fact.join(side, key, "left")
    if where is not None:
        view = fact.select("*", F.struct(*[F.col(f"dim_{n}").alias(n) for n in needed]).alias("dim"))
        fact = view.filter(where)
    groups = [F.col(f"dim_{d.name}").alias(d.name) for _, d in wanted]
    if not reduced:
        measures = {n: F.expr(p) for n, (p, _) in parts.items()} | {t.name: F.expr(t.expr) for t in terms if not t.parts}
    else:
        measures = {n: F.expr(f"{merge}(part_{n})") for n, (_, merge) in parts.items()}
    out = fact.groupBy(*groups) if groups else fact.groupBy()
    out = out.agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(*[d.name for _, d in wanted], *[F.expr(t.expr).alias(t.name) if t.parts else F.col(t.name) for t in terms])


def _same_groups(a: DataFrame, b: DataFrame, labels: list[str]) -> DataFrame:
    """Full outer join of two aggregated results on their groups; NULL groups match."""
    if not labels:
        # two one-row results side by side
        return a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])
    right = b.withColumnsRenamed({d: f"_r_{d}" for d in labels})
    same = reduce(lambda x, y: x & y, [F.col(d).eqNullSafe(F.col(f"_r_{d}")) for d in labels])
    joined = a.join(right, same, "full")
    keys = [F.coalesce(d, f"_r_{d}").alias(d) for d in labels]
    rest = [c for c in (*a.columns, *b.columns) if c not in labels]
    return joined.select(*keys, *rest)


def checked(model: SemanticModel, frames: dict[str, DataFrame]) -> SemanticModel:
    """``model``, or a ValueError with all its problems."""
    found = problems(model, frames)
    if found:
        raise ValueError("the model does not fit its tables:\n" + "\n".join(found))
    return model


# --- the built-in model ----------------------------------------------------------------------
# Metric and dimension names, and what each computes.


def _terms(**exprs: str) -> list[dict]:
    return [{"name": n, "expr": e} for n, e in exprs.items()]


def _columns(*names: str) -> list[dict]:
    return [{"name": n, "expr": n} for n in names]


def _total(column: str) -> str:
    """Sum of a column with up to six decimals as whole millionths: the same in any order of rows, and exact up to 10^32."""
    return f"cast(sum(cast(rint({column} * 1e6) as decimal(38, 0))) as double) / 1e6"


def _mean(column: str) -> str:
    return f"{_total(column)} / count({column})"


MODEL = SemanticModel.from_dict(
    {
        "tables": [
            {
                "name": "customer_health",
                "dimensions": _columns("customer_id", "risk_level"),
                "time_dimensions": _columns("scored_at"),
                "measures": _terms(
                    customer_count="count(distinct customer_id)",
                    avg_health_score=_mean("health_score"),
                    avg_churn_risk=_mean("churn_risk"),
                    churn_rate="count_if(churn_risk >= 0.4) / nullif(count(*), 0)",
                    critical_customers="count_if(risk_level = 'CRITICAL')",
                    avg_sentiment=_mean("sentiment_score"),
                    avg_payment_score=_mean("payment_score"),
                    avg_engagement_score=_mean("engagement_score"),
                ),
            },
            {
                "name": "customer",
                "dimensions": _columns("customer_id", "segment", "region", "state", "gender"),
                "time_dimensions": _columns("created_at"),
                "measures": _terms(
                    total_customers="count(distinct customer_id)",
                    avg_tenure_months=_mean("tenure_months"),
                    avg_lifetime_value=_mean("lifetime_value"),
                    total_lifetime_value=_total("lifetime_value"),
                ),
            },
            {
                "name": "policy",
                "dimensions": _columns("policy_id", "customer_id", "policy_type", "status"),
                "time_dimensions": _columns("start_date", "end_date"),
                "measures": _terms(
                    policy_count="count(distinct policy_id)",
                    avg_premium=_mean("premium_amount"),
                    total_premium=_total("premium_amount"),
                    active_policies="count_if(status = 'Active')",
                ),
            },
            {
                "name": "next_best_action_log",
                "dimensions": _columns("action_type", "decision", "outcome", "decided_by"),
                "time_dimensions": _columns("decided_at", "outcome_date"),
                "measures": _terms(
                    action_count="count(distinct action_id)",
                    approval_rate="count_if(decision = 'APPROVED') / nullif(count(*), 0)",
                    rejection_rate="count_if(decision = 'REJECTED') / nullif(count(*), 0)",
                    effectiveness="count_if(outcome = 'SUCCESSFUL') / nullif(count(outcome), 0)",
                ),
            },
        ],
        "relationships": [{"table": "customer_health", "key": "customer_id", "target": "customer"}],
    }
)

def _added(name: str, column: str) -> dict[str, tuple[str, str]]:
    """Parts of a sum as in ``_total``, and of the number of its values."""
    return {f"{name}_micro": (f"sum(cast(rint({column} * 1e6) as decimal(38, 0)))", "sum"), f"{name}_n": (f"count({column})", "sum")}


#: Claims by attributes of their policy and, one hop further, of the customer who holds it.
CLAIMS = SemanticModel.from_dict(
    {
        "tables": [
            {
                "name": "claim",
                "dimensions": _columns("claim_type"),
                "measures": [
                    {"name": "claim_count", "expr": "rows", "parts": {"rows": ("count(*)", "sum")}},
                    {"name": "claimed_amount", "expr": "cast(amount_micro as double) / 1e6", "parts": _added("amount", "claim_amount")},
                    {"name": "avg_claim", "expr": "cast(amount_micro as double) / 1e6 / nullif(amount_n, 0)", "parts": _added("amount", "claim_amount")},
                    {"name": "largest_claim", "expr": "largest", "parts": {"largest": ("max(claim_amount)", "max")}},
                    {
                        "name": "open_share", "expr": "unresolved / nullif(rows, 0)",
                        "parts": {"unresolved": ("count_if(status in ('Open', 'Under Review'))", "sum"), "rows": ("count(*)", "sum")},
                    },
                ],
            },
            {
                "name": "policy", "dimensions": _columns("policy_type"),
                "measures": [{"name": "policies", "expr": "held", "parts": {"held": ("count(*)", "sum")}}],
            },
            {"name": "customer", "dimensions": _columns("segment", "region")},
        ],
        "relationships": [
            {"table": "claim", "key": "policy_id", "target": "policy"},
            {"table": "policy", "key": "customer_id", "target": "customer"},
        ],
    }
)

VIEW = SemanticModel.from_dict(
    {
        "tables": [
            {
                "name": "customer_health",
                "dimensions": [{"name": "risk_level", "expr": "risk_level", "synonyms": ["risk category"]}],
                "measures": [
                    {"name": "customer_count", "expr": "count(distinct customer_id)", "synonyms": ["total customers"]},
                    {"name": "avg_health", "expr": _mean("health_score"), "synonyms": ["average health"]},
                    {"name": "avg_churn_risk", "expr": _mean("churn_risk"), "synonyms": ["average churn risk"]},
                    {
                        "name": "critical_count", "expr": "count_if(risk_level = 'CRITICAL')",
                        "synonyms": ["critical alerts"],
                    },
                ],
            },
            {
                "name": "customers",
                "dimensions": [
                    {"name": "segment", "expr": "segment", "synonyms": ["customer segment", "tier"]},
                    {"name": "region", "expr": "region", "synonyms": ["geographic region"]},
                ],
            },
            {
                "name": "nba",
                "dimensions": [
                    {"name": "action_type", "expr": "action_type", "synonyms": ["action", "recommendation type"]},
                    {"name": "nba_status", "expr": "status", "synonyms": ["action status"]},
                ],
                "measures": [
                    {"name": "action_count", "expr": "count(distinct action_id)", "synonyms": ["recommendation count"]}
                ],
            },
        ],
        "relationships": [
            {"table": "customer_health", "key": "customer_id", "target": "customers"},
            {"table": "nba", "key": "customer_id", "target": "customers"},
        ],
    }
)
