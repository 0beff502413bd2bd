"""Walks Spark's parsed plans and notes what lineage needs as rows of flat relations.

The session's parser lives on the driver, so statements are parsed there, each different text once; what comes out are
narrow rows under the text's key, which go to the shared folder whenever they have become many. Everything after
that is joins and windows. Scopes and queries are numbered within a statement. Relations, each with the key of its text:

statements   kind, target_table, target_cols, root (query), error
branches     query, branch, scope, level     the SELECTs of a query in order; a level is above all scopes it reads from
sources      scope, src_ord, alias, kind, table_name, child, names      FROM items in order
pivots       scope, src_ord, names, refs     generated columns and the columns they aggregate
projections  scope, proj, kind, out_name, qualifier, expression, is_column
refs         scope, proj, ref_ord, qualifier, name, inner (it stands in a nested SELECT)
subs         scope, proj, sub_ord, sub_scope SELECTs nested in a projection
assignments  n, target_column, expression, from_table, target_alias, from_alias, from_query
assigned     n, ref_ord, qualifier, name
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import normalized

SCHEMAS = {
    "statements": "key string, kind string, target_table string, target_cols array<string>, root string, error string",
    "branches": "key string, query string, branch int, scope string, level int",
    "sources": "key string, scope string, src_ord int, alias string, kind string, table_name string, child string, names array<string>",
    "pivots": "key string, scope string, src_ord int, names array<string>, refs array<string>",
    "projections": "key string, scope string, proj int, kind string, out_name string, qualifier string, expression string, is_column boolean",
    "refs": "key string, scope string, proj int, ref_ord int, qualifier string, name string, inner boolean",
    "subs": "key string, scope string, proj int, sub_ord int, sub_scope string",
    "assignments": "key string, n int, target_column string, expression string, from_table string, target_alias string, from_alias string, from_query string",
    "assigned": "key string, n int, ref_ord int, qualifier string, name string",
}
#: Columns that name a scope or query of the statement.
PLACES = ("query", "scope", "child", "sub_scope", "root", "from_query")

#: Plan nodes around a SELECT that say nothing about columns.
_AROUND = {"Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Filter", "UnresolvedHaving", "WithWindowDefinition", "UnresolvedHint", "RepartitionByExpression", "Deduplicate", "Sample", "Tail", "UnresolvedQualify"}
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
_SETS = {"Union", "Intersect", "Except"}

_UPDATE = re.compile(r"^\s*UPDATE\s+(?P<target>[\w.`]+)(?:\s+(?:AS\s+)?(?P<alias>(?!SET\b)\w+))?\s+SET\s+", re.I)
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[()]|\b(?:FROM|WHERE)\b", re.I)
_WITH_CTAS = re.compile(r"^(?P<with>\s*WITH\b.*\))\s*(?P<create>CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+[\w.`]+)\s+AS\s+(?P<query>.*)$", re.I | re.S)


def update_from(sql: str) -> str | None:
    """UPDATE ... FROM as the MERGE that Spark's grammar has; None for any other statement."""
    head = _UPDATE.match(sql)
    if not head:
        return None
    depth, at = 0, {}
    for token in _TOKEN.finditer(sql, head.end()):
        word = token.group().upper()
        depth += (word == "(") - (word == ")")
        if depth == 0 and word in ("FROM", "WHERE"):
            at.setdefault(word, token.span())
    if "FROM" not in at:
        return None
    begin, stop = at["FROM"][1], at["WHERE"][0] if "WHERE" in at else len(sql)
    on = sql[at["WHERE"][1] :] if "WHERE" in at else "true"
    return f"MERGE INTO {head['target']} {head['alias'] or ''} USING {sql[begin:stop].strip()} ON {on} WHEN MATCHED THEN UPDATE SET {sql[head.end() : at['FROM'][0]]}"


def levels(branches: list[tuple], sources: list[tuple], subs: list[tuple]) -> dict[str, int]:
    """Each scope's level, above all scopes it reads from; a way back to a scope that is being followed counts for nothing."""
    scopes: dict[str, list[str]] = {}
    for _, query, _, scope, _ in branches:
        scopes.setdefault(query, []).append(scope)
    below: dict[str, list[str]] = {}
    for row in sources:
        below.setdefault(row[1], []).extend(scopes.get(row[6], ()))
    for _, scope, _, _, nested in subs:
        below.setdefault(scope, []).append(nested)
    level: dict[str, int] = {}
    for _, _, _, first, _ in branches:
        if first in level:
            continue
        path, height = [(first, iter(below.get(first, ())))], {first: -1}
        while path:
            scope, rest = path[-1]
            for b in rest:
                if b in level:
                    height[scope] = max(height[scope], level[b])
                elif b not in height:
                    height[b] = -1
                    path.append((b, iter(below.get(b, ()))))
                    break
            else:
                path.pop()
                level[scope] = 1 + height.pop(scope)
                if path:
                    height[path[-1][0]] = max(height[path[-1][0]], level[scope])
    return level


def _seq(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _name(parts) -> str:
    return normalized(".".join(_seq(parts)))


@dataclass
class Walker:
    spark: SparkSession
    mode: str = "compat"  # in compat a WITH in a nested query names no queries
    rows: dict[str, list[tuple]] = field(default_factory=lambda: {name: [] for name in SCHEMAS})
    key: str = ""
    _made: int = 0

    def statement(self, key: str, sql: str) -> None:
        """The rows of a statement. One that the parser rejects is a row with its error, one that says nothing about columns none."""
        parser = self.spark._jsparkSession.sessionState().sqlParser()
        update = update_from(sql)
        parsed = update or sql
        if not update and (found := _WITH_CTAS.match(sql)):
            parsed = f"{found['create']} AS {found['with']} {found['query']}"
        try:
            plan = parser.parsePlan(parsed)
        except Exception as error:  # noqa: BLE001  the parser's own, or py4j's around it
            self.rows["statements"].append((key, "error", None, [], None, str(error).strip().split("\n")[0]))
            return
        self.key, self.sql, self.ctes, self.using, self._made = key, parsed, {}, (None, None, None, None), 0
        before = {name: len(self.rows[name]) for name in ("branches", "sources", "subs")}
        made = self._statement(plan)
        own = {name: self.rows[name][n:] for name, n in before.items()}
        level = levels(**own)
        self.rows["branches"][before["branches"] :] = [(k, q, b, s, level[s]) for k, q, b, s, _ in own["branches"]]
        if made is not None:
            kind, target, cols, root = made
            self.rows["statements"].append((key, "update" if update else kind, target, cols, root, None))

    def held(self) -> int:
        return sum(map(len, self.rows.values()))

    def take(self) -> dict[str, DataFrame]:
        """The rows so far as DataFrames; the next ones begin anew."""
        out = {name: self.spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in self.rows.items()}
        self.rows = {name: [] for name in SCHEMAS}
        return out

    def _statement(self, plan) -> tuple | None:
        kind = _kind(plan)
        if kind == "UnresolvedWith":
            self._register(plan)
            return self._statement(plan.child())
        if kind in ("CreateTableAsSelect", "ReplaceTableAsSelect", "CreateView", "CreateViewCommand"):
            target = plan.name() if kind.endswith("Select") else (plan.child() if kind == "CreateView" else None)
            name = self._identifier(target) if target is not None else normalized(plan.name().unquotedString())
            query = plan.query() if kind != "CreateViewCommand" else plan.plan()
            listed = [normalized(c._1()) for c in _seq(plan.userSpecifiedColumns())] if kind.startswith("CreateView") else []
            return "ctas", name, listed, self._root(query)
        if kind == "InsertIntoStatement":
            cols = [normalized(c) for c in _seq(plan.userSpecifiedCols())]
            return "insert", self._identifier(plan.table()), cols, self._root(plan.query())
        if kind == "UpdateTable":
            target, table = self._identifier(plan.table()), plan.table()
            self.using = (None, normalized(table.identifier().name()) if _kind(table) == "SubqueryAlias" else None, None, None)
            self._assign([(a.key(), a.value()) for a in _seq(plan.assignments())], 0)
            return "update", target, [], None
        if kind == "MergeIntoTable":
            n = 0
            self.using = self._using(plan)
            for action in [*_seq(plan.matchedActions()), *_seq(plan.notMatchedActions())]:
                if _kind(action) in ("UpdateAction", "InsertAction"):
                    n = self._assign([(a.key(), a.value()) for a in _seq(action.assignments())], n)
            return "merge", self._identifier(plan.targetTable()), [], None
        root = self._root(plan)
        return ("select", None, [], root) if root else None

    def _using(self, plan) -> tuple[str | None, str | None, str | None, str | None]:
        """Of a MERGE: the source's table, the target's alias, the source's alias, the source's query."""
        alias = lambda node: normalized(node.identifier().name()) if _kind(node) == "SubqueryAlias" else None
        source, target = plan.sourceTable(), plan.targetTable()
        table = self._identifier(source)
        query = self.ctes.get(table)
        inner = source
        while _kind(inner) == "SubqueryAlias":
            inner = inner.child()
        if table is None and _kind(inner) in ("Project", "Aggregate", *_SETS, *_AROUND, "UnresolvedWith"):
            query = self._root(inner)
        return (None if query else table), alias(target), alias(source) or (table if query else None), query

    def _identifier(self, node) -> str | None:
        while _kind(node) == "SubqueryAlias":
            node = node.child()
        if _kind(node) == "UnresolvedRelation":
            return _name(node.multipartIdentifier())
        return _name(node.nameParts()) if _kind(node) == "UnresolvedIdentifier" else None

    def _root(self, plan) -> str | None:
        if _kind(plan) == "UnresolvedWith":
            self._register(plan)
            plan = plan.child()
        return self._query(plan)

    def _register(self, plan) -> None:
        """Names first, then bodies, so that they see each other in any order."""
        made = [(normalized(c._1()), c._2().child(), self._new()) for c in _seq(plan.cteRelations())]
        self.ctes |= {name: query for name, _, query in made}
        for _, body, query in made:
            self._query(body, query)

    def _new(self) -> str:
        self._made += 1
        return str(self._made)

    def _strip(self, plan):
        while _kind(plan) in _AROUND:
            plan = plan.child()
        return plan

    def _selects(self, plan) -> list:
        plan = self._strip(plan)
        kind = _kind(plan)
        if kind in _SETS:
            return [s for child in _seq(plan.children()) for s in self._selects(child)]
        if kind in ("Project", "Aggregate"):
            return [plan]
        return self._selects(plan.child()) if kind in ("UnresolvedWith", "SubqueryAlias") else []

    def _query(self, plan, query: str | None = None) -> str | None:
        selects = self._selects(plan)
        if not selects and query is None:
            return None
        query = query or self._new()
        for branch, select in enumerate(selects):
            self.rows["branches"].append((self.key, query, branch, self._select(select), 0))
        return query

    def _select(self, plan) -> str:
        scope = self._new()
        self._from(plan.child(), scope, [0])
        items = plan.projectList() if _kind(plan) == "Project" else plan.aggregateExpressions()
        for proj, item in enumerate(_seq(items)):
            self._projection(scope, proj, item)
        return scope

    def _from(self, plan, scope: str, at: list[int], alias: str | None = None, names: list | None = None) -> None:
        plan = self._strip(plan)
        kind = _kind(plan)
        add = lambda key, what, table=None, child=None, cols=(): (self.rows["sources"].append((self.key, scope, at[0], key, what, table, child, list(cols))), at.__setitem__(0, at[0] + 1))
        if kind in ("Join", "AsOfJoin"):
            self._from(plan.left(), scope, at)
            self._from(plan.right(), scope, at)
        elif kind == "LateralJoin":
            self._from(plan.left(), scope, at)
        elif kind == "Generate":
            self._from(plan.child(), scope, at)
        elif kind == "SubqueryAlias":
            own = normalized(plan.identifier().name())
            self._from(plan.child(), scope, at, None if own.startswith("__auto_generated") else own, names)
        elif kind == "UnresolvedSubqueryColumnAliases":
            self._from(plan.child(), scope, at, alias, [normalized(c) for c in _seq(plan.outputColumnNames())])
        elif kind == "UnresolvedRelation":
            table = _name(plan.multipartIdentifier())
            key = alias or table.split(".")[-1]
            child = self.ctes.get(table) or self.ctes.get(key)
            add(key, "query" if child else "table", None if child else table, child)
        elif kind == "Pivot":
            before = at[0]
            if _kind(self._strip(plan.child())) == "Join":  # what a pivot makes of a join has all columns of the join
                query, inner = self._new(), self._new()
                self._from(plan.child(), inner, [0])
                self.rows["projections"].append((self.key, inner, 0, "star", None, None, "*", False))
                self.rows["branches"].append((self.key, query, 0, inner, 0))
                add(alias or "_q_pivot", "query", child=query)
            else:
                self._from(plan.child(), scope, at, alias)
            if at[0] > before:
                refs = [normalized(_seq(a.nameParts())[-1]) for e in _seq(plan.aggregates()) for a in self._attributes(e)]
                self.rows["pivots"].append((self.key, scope, at[0] - 1, self._generated(plan), refs))
        elif kind in ("LocalRelation", "UnresolvedInlineTable"):
            width = [a.name() for a in _seq(plan.output())] if kind == "LocalRelation" else _seq(plan.names())
            add(alias or "_values", "values", cols=names or [normalized(c) for c in width])
        elif kind in ("Project", "Aggregate", *_SETS, "UnresolvedWith"):
            child = self._root(plan) if self.mode == "resolved" else self._query(plan)
            if child:
                add(alias or "_q_derived", "query", child=child)

    def _generated(self, plan) -> list[str]:
        aggregates = _seq(plan.aggregates())
        out = []
        for value in _seq(plan.pivotValues()):
            name = value.name() if _kind(value) == "Alias" else value.toString() if _kind(value) != "Literal" else str(value.value().toString())
            for a in aggregates:
                own = a.name() if _kind(a) == "Alias" else self._text(a)
                out.append(normalized(name if len(aggregates) == 1 else f"{name}_{own}"))
        return out

    def _text(self, e) -> str:
        """The text of an expression as written."""
        while _kind(e) in ("Alias", "UnresolvedAlias"):
            e = e.child()
        o = e.origin()
        if o.startIndex().isDefined() and o.stopIndex().isDefined():
            return self.sql[o.startIndex().get() : o.stopIndex().get() + 1]
        return e.sql()

    def _attributes(self, e) -> list:
        return [a for a, _ in self._placed(e)]

    def _placed(self, e) -> list[tuple]:
        """Column references in an expression, and whether they stand in a nested query."""
        out, todo = [], deque([(e, False)])
        while todo:
            x, inner = todo.popleft()
            if _kind(x) == "UnresolvedAttribute":
                out.append((x, inner))
            todo.extend((c, inner) for c in _seq(x.children()))
            if _kind(x) in _SUBQUERIES:
                plans = deque([x.plan()])
                while plans:
                    p = plans.popleft()
                    todo.extend((c, True) for c in _seq(p.expressions()))
                    plans.extend(_seq(p.children()))
        return out

    def _projection(self, scope: str, proj: int, item) -> None:
        kind = _kind(item)
        if "Star" in kind:
            target = item.target()
            qualifier = normalized(_seq(target.get())[-1]) if target.isDefined() else None
            self.rows["projections"].append((self.key, scope, proj, "qualified" if qualifier else "star", None, qualifier, f"{qualifier}.*" if qualifier else "*", False))
            return
        e, out = item, None
        if kind == "Alias":
            e, out = item.child(), normalized(item.name())
        while _kind(e) in ("UnresolvedAlias",):
            e = e.child()
        column = _kind(e) == "UnresolvedAttribute"
        if column and out is None:
            out = normalized(_seq(e.nameParts())[-1])
        self.rows["projections"].append((self.key, scope, proj, "expression", out, None, self._text(e), column))
        for n, (a, inner) in enumerate(self._placed(e)):
            parts = _seq(a.nameParts())
            self.rows["refs"].append((self.key, scope, proj, n, normalized(parts[-2]) if len(parts) > 1 else None, normalized(parts[-1]), inner))
        todo, n = deque([e]), 0
        while todo:
            x = todo.popleft()
            if _kind(x) in _SUBQUERIES:
                before = len(self.rows["branches"])
                self._query(x.plan())
                for _, _, _, nested, _ in self.rows["branches"][before:]:
                    self.rows["subs"].append((self.key, scope, proj, n, nested))
                    n += 1
            todo.extend(_seq(x.children()))

    def _assign(self, pairs: list, n: int) -> int:
        for key, value in pairs:
            if _kind(key) != "UnresolvedAttribute":
                continue
            self.rows["assignments"].append((self.key, n, normalized(_seq(key.nameParts())[-1]), self._text(value), *self.using))
            for k, a in enumerate(self._attributes(value)):
                parts = _seq(a.nameParts())
                self.rows["assigned"].append((self.key, n, k, normalized(parts[-2]) if len(parts) > 1 else None, normalized(parts[-1])))
            n += 1
        return n
