"""Row policies of all tables as a declared catalogue, compiled to filters for a viewer.

A policy says which rows of a table an operation may touch (`using`), or how new rows must look (`check`). Terms read as in
the catalogue: a column equals the viewer's group or user, the viewer belongs to or owns a row's group, an event is visible,
a row of another table refers to this one. That other table is itself seen through its select policy, so that chains end
at what the viewer may see. What no policy names is barred.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.visibility import Viewer, event_visible


@dataclass(frozen=True)
class Is:
    """A column holds the viewer's `what`: group or user."""

    column: str
    what: str


@dataclass(frozen=True)
class Belongs:
    """The viewer is a member of the group in `column`; with `owner` its owner."""

    column: str
    owner: bool = False


@dataclass(frozen=True)
class Null:
    column: str


@dataclass(frozen=True)
class Visible:
    """The event's own rule: contributed, present, or open to the group."""


@dataclass(frozen=True)
class Refers:
    """A row of `table` that the viewer may select has, in `theirs`, the value in `own` (an element of it, if a list)."""

    own: str
    table: str
    theirs: str
    many: bool = False


@dataclass(frozen=True)
class SharesGroup:
    """The user in `column` is a member of the viewer's group."""

    column: str


@dataclass(frozen=True)
class Any:
    terms: tuple


@dataclass(frozen=True)
class Policy:
    """All terms hold. using: rows an operation may touch; check: what rows it writes must satisfy."""

    using: tuple | None = None
    check: tuple | None = None


IN_GROUP, MINE = Is("group_id", "group"), Is("by_user_id", "user")
OWNER, MEMBER = Belongs("group_id", owner=True), Belongs("group_id")
_SELF_OR_OWNER = (Any((Is("user_id", "user"), OWNER)),)
_BLOB, _FACE, _EVENT = Refers("blob_id", "blobs", "id"), Refers("face_id", "faces", "id"), Refers("event_id", "events", "id")
_LIVE_BLOB = (IN_GROUP, Refers("id", "assets", "blob_id"))
_MY_ASSET = (IN_GROUP, Is("owner_user_id", "user"))


def _rows(*terms) -> Policy:
    return Policy(using=terms)


def _new(*terms) -> Policy:
    return Policy(check=terms)


#: Which operation on which table which rule governs, 49 policies; one for "all" stands for four operations.
CATALOGUE: dict[str, dict[str, Policy]] = {
    "groups": {"select": _rows(Belongs("id")), "insert": _new(Is("created_by", "user")), "update": _rows(Belongs("id", owner=True)), "delete": _rows(Belongs("id", owner=True))},
    "group_members": {"select": _rows(MEMBER), "insert": _new(*_SELF_OR_OWNER), "update": _rows(*_SELF_OR_OWNER), "delete": _rows(*_SELF_OR_OWNER)},
    "group_invites": {"all": Policy(using=(OWNER,), check=(OWNER, Is("created_by", "user")))},
    "devices": {"select": _rows(Any((Is("user_id", "user"), SharesGroup("user_id")))), "insert": _new(Is("user_id", "user")), "update": _rows(Is("user_id", "user")), "delete": _rows(Is("user_id", "user"))},
    "blobs": {"select": _rows(*_LIVE_BLOB), "insert": _new(IN_GROUP), "update": _rows(*_LIVE_BLOB)},
    "assets": {
        "select": _rows(IN_GROUP, Any((Is("owner_user_id", "user"), Refers("id", "event_assets", "asset_id")))),
        "insert": _new(*_MY_ASSET), "update": _rows(*_MY_ASSET), "delete": _rows(*_MY_ASSET),
    },
    "derivatives": {"select": _rows(_BLOB)},
    "persons": {"select": _rows(IN_GROUP), "insert": _new(IN_GROUP), "update": _rows(IN_GROUP), "delete": _rows(IN_GROUP, *_SELF_OR_OWNER)},
    "faces": {"select": _rows(_BLOB), "update": _rows(_BLOB)},
    "face_labels": {"select": _rows(_FACE), "insert": _new(MINE, _FACE), "update": _rows(_FACE), "delete": _rows(_FACE)},
    "unknown_clusters": {"select": _rows(IN_GROUP, Refers("face_ids", "faces", "id", many=True)), "update": _rows(IN_GROUP)},
    "places": {"select": _rows(IN_GROUP), "update": _rows(IN_GROUP)},
    "events": {"select": _rows(Null("deleted_at"), Visible()), "update": Policy(using=(Visible(),), check=(IN_GROUP,))},
    "event_assets": {"select": _rows(_EVENT), "insert": _new(_EVENT), "delete": _rows(_EVENT)},
    "event_person_tags": {"select": _rows(_EVENT), "insert": _new(MINE, _EVENT), "delete": _rows(_EVENT)},
    "moments": {"select": _rows(_EVENT)},
    "event_constraints": {"select": _rows(IN_GROUP), "insert": _new(IN_GROUP, MINE), "delete": _rows(IN_GROUP, MINE)},
    "audit_log": {"insert": _new(Any((Null("group_id"), IN_GROUP))), "select": _rows(OWNER)},
}


class Secured:
    """The tables of a library as one viewer may touch them. `tables`: name -> DataFrame with the catalogue's columns."""

    def __init__(self, tables: dict[str, DataFrame], viewer: Viewer, catalogue: dict[str, dict[str, Policy]] = CATALOGUE):
        self.tables, self.viewer, self.catalogue = tables, viewer, catalogue

    def policy(self, table: str, operation: str) -> Policy:
        own = self.catalogue.get(table, {})
        if operation not in own and "all" not in own:
            raise PermissionError(f"no policy lets anyone {operation} {table}")
        return own.get(operation) or own["all"]

    def rows(self, table: str, operation: str = "select") -> DataFrame:
        """The rows of a table that the viewer may select, update or delete."""
        policy = self.policy(table, operation)
        if policy.using is None:
            raise PermissionError(f"{operation} on {table} touches no rows that are there")
        return self._kept(self.tables[table], policy.using)

    def permitted(self, table: str, new: DataFrame, operation: str = "insert") -> DataFrame:
        """The rows of `new` that the viewer may write; an update without a check of its own must keep to its `using`."""
        policy = self.policy(table, operation)
        return self._kept(new, policy.check if policy.check is not None else policy.using)

    def _kept(self, rows: DataFrame, terms: tuple) -> DataFrame:
        columns = rows.columns
        for n, term in enumerate(terms):
            rows = self._told(rows, term, f"_term{n}")
            rows = rows.where(F.coalesce(F.col(f"_term{n}"), F.lit(False)))
        return rows.select(columns)

    def _told(self, rows: DataFrame, term, name: str) -> DataFrame:
        """Adds a boolean column: whether the term holds of a row. Joins meet distinct keys, so that no row repeats."""
        viewer = self.viewer
        if isinstance(term, Is):
            return rows.withColumn(name, F.col(term.column) == F.lit(getattr(viewer, term.what)))
        if isinstance(term, Null):
            return rows.withColumn(name, F.col(term.column).isNull())
        if isinstance(term, Visible):
            return rows.withColumn(name, event_visible(viewer, "group_id", "contributor_ids", "person_ids", "is_public_to_group"))
        if isinstance(term, Any):
            for n, part in enumerate(term.terms):
                rows = self._told(rows, part, f"{name}_{n}")
            either = F.lit(False)
            for n in range(len(term.terms)):
                either = either | F.coalesce(F.col(f"{name}_{n}"), F.lit(False))
            return rows.withColumn(name, either)
        own = self.tables["group_members"]  # read as it is: these two rules look past the policies
        if isinstance(term, Belongs):
            mine = own.where(F.col("user_id") == F.lit(viewer.user))
            return self._met(rows, term.column, mine.where("role = 'owner'") if term.owner else mine, "group_id", name)
        if isinstance(term, SharesGroup):
            return self._met(rows, term.column, self.rows("group_members").where(F.col("group_id") == F.lit(viewer.group)), "user_id", name)
        if term.many:
            key = [c for c in rows.columns if c == "id"]
            found = self._met(rows.select(*key, F.explode(term.own).alias("_one")), "_one", self.rows(term.table), term.theirs, "_hit")
            return rows.join(found.where("_hit").select(*key).distinct().withColumn(name, F.lit(True)), key, "left")
        return self._met(rows, term.own, self.rows(term.table), term.theirs, name)

    @staticmethod
    def _met(rows: DataFrame, own: str, others: DataFrame, theirs: str, name: str) -> DataFrame:
        keys = others.select(F.col(theirs).alias("_key")).distinct().withColumn(name, F.lit(True))
        return rows.join(keys, F.col(own) == F.col("_key"), "left").drop("_key")
