"""Replay of formulation actions, in batch and as a stream.

What can be said of an action by itself is said in columns: trimmed terms, values of
fields, cleaned claims, quantities as text, and why it is refused whatever the
state.  What depends on the formulation is a short step: it looks at the state, and
either refuses or changes a few entries.  Actions of one formulation are
applied in order of ``seq``.  An action based on another version than the current
one is a conflict, an impossible one is rejected; both leave the state as it is.

Terms and identities are carried by the actions: ``botanical_name`` and ``synonyms``
of a term that is resolved, ``candidates`` of one that is not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Allowed values of the enumerated fields, and fields with a value of their own.
ENUMS = {
    "purpose": ["commercial_utilization", "research", "bio_survey", "ipr"],
    "entity_type": ["indian", "foreign"],
    "resource_source": ["wild", "cultivated", "unknown"],
    "legal_scope": ["domestic", "international"],
}
DEFAULTS = {"legal_scope": "domestic", "jurisdiction": "india"}
ON_INGREDIENTS = ["REMOVE_INGREDIENT", "UPDATE_INGREDIENT", "RESOLVE_ENTITY"]
ON_FIELDS = {"UPDATE_DOSAGE_FORM": "dosage_form", "UPDATE_INTENDED_USE": "intended_use"}
TYPES = ["ADD_INGREDIENT", *ON_INGREDIENTS, "RESOLVE_BOTANICALS", *ON_FIELDS, "UPDATE_CLAIMS", "UPDATE_FIELD", "CONFIRM_FORMULATION"]
ACTION_FIELDS = ["seq", "base_version", "type", "ingredient_id", "user_term", "quantity", "unit", "plant_part", "botanical_name", "field", "value", "claims"]
CANDIDATES = "array<struct<botanical_name:string,synonyms:array<string>>>"
OUTPUT = "formulation_id long, seq long, status string, version long, summary string, n_ingredients long, snapshot string"
BUFFER = 10_000  # actions of a formulation held in memory ahead of their turn
SHOWN = ["id", "user_term", "quantity", "unit", "plant_part", "botanical_name"]


def _amount(quantity: Column, unit: Column) -> Column:
    whole = F.when(quantity == F.floor(quantity), quantity.cast("decimal(38,0)").cast("string")).otherwise(quantity.cast("string"))
    return F.when(quantity.isNull(), "no quantity").otherwise(F.trim(F.concat_ws(" ", whole, unit)))


def prepared(actions: DataFrame) -> DataFrame:
    """Actions with what needs no state: clean values, and ``refused``, the reason if there is one in the action alone."""
    optional = {"synonyms": "array<string>", "candidates": CANDIDATES}
    rows = actions.select("formulation_id", *ACTION_FIELDS, *[F.col(c).cast(t) if c in actions.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()])
    raw, kind = strip(F.coalesce("value", F.lit(""))), F.col("type")
    field = F.when(kind == "UPDATE_FIELD", F.coalesce("field", F.lit(""))).otherwise(F.element_at(F.create_map(*[F.lit(x) for p in ON_FIELDS.items() for x in p]), kind))
    given = F.nullif(raw, F.lit(""))
    allowed = F.element_at(F.create_map(*[x for k, v in ENUMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("field"))
    default = F.element_at(F.create_map(*[F.lit(x) for p in DEFAULTS.items() for x in p]), F.col("field"))
    checked = F.when(allowed.isNotNull(), F.lower(given)).otherwise(given)
    value = F.when(kind == "UPDATE_FIELD", F.coalesce(checked, default)).when(kind == "UPDATE_DOSAGE_FORM", F.lower(raw)).when(kind == "UPDATE_INTENDED_USE", raw)
    wrong = (kind == "UPDATE_FIELD") & given.isNotNull() & allowed.isNotNull() & ~F.array_contains(allowed, F.lower(given))
    quote = F.when(given.contains("'") & ~given.contains('"'), '"').otherwise("'")
    refused = F.when(~F.coalesce(kind.isin(TYPES), F.lit(False)), F.concat(F.lit("Unsupported action "), F.coalesce(kind, F.lit("None")), F.lit("."))).when(
        wrong, F.concat(F.lit("Invalid "), "field", F.lit(": "), quote, F.lower(given), quote, F.lit(". Allowed: "), F.array_join(allowed, ", "), F.lit("."))
    )
    claims = F.filter(F.transform(F.coalesce("claims", F.array().cast("array<string>")), strip), lambda c: c != "")
    return rows.select(
        "formulation_id", "seq", "base_version", "type", "ingredient_id", strip(F.coalesce("user_term", F.lit(""))).alias("user_term"), "quantity", "unit", "plant_part",
        F.nullif(strip(F.col("botanical_name")), F.lit("")).alias("botanical_name"), F.to_json(F.coalesce("synonyms", F.array().cast("array<string>"))).alias("synonyms"), F.to_json(F.coalesce("candidates", F.array().cast(CANDIDATES))).alias("candidates"),
        field.alias("field"), value.alias("value"), F.to_json(claims).alias("claims"), F.size(claims).alias("n_claims"), _amount(F.col("quantity"), F.col("unit")).alias("amount"), refused.alias("refused"),
    )


class Rejected(Exception):
    pass


class Formulation:
    """The state of one formulation: ingredients by id, fields, claims, version, and the next ``seq``."""

    def __init__(self) -> None:
        self.ingredients: dict[str, dict[str, Any]] = {}
        self.fields: dict[str, str | None] = dict(DEFAULTS)
        self.claims, self.version, self.confirmed, self.next = "[]", 1, False, None

    def snapshot(self) -> str:
        rows = [{k: i[k] for k in SHOWN} for i in self.ingredients.values()]
        return json.dumps({"ingredients": rows, "fields": self.fields, "claims": json.loads(self.claims), "confirmed": self.confirmed}, ensure_ascii=False, sort_keys=True)

    def take(self, a: dict[str, Any]) -> tuple[str, str]:
        """Status and summary of the next action."""
        if a["base_version"] is not None and int(a["base_version"]) != self.version:
            return "conflict", f"Based on version {int(a['base_version'])}, current is {self.version}."
        if a["refused"]:
            return "rejected", a["refused"]
        try:
            summary = self._change(a)
        except Rejected as reason:
            return "rejected", str(reason)
        self.version += 1
        return "applied", summary

    def _change(self, a: dict[str, Any]) -> str:
        kind = a["type"]
        if kind == "ADD_INGREDIENT":
            return self._add(a)
        if kind in ON_INGREDIENTS:
            row = self.ingredients.get(a["ingredient_id"])
            if row is None:
                raise Rejected("That ingredient is not in the current formulation.")
            if kind == "REMOVE_INGREDIENT":
                del self.ingredients[row["id"]]
                return f"Removed {row['user_term']}"
            return self._update(row, a) if kind == "UPDATE_INGREDIENT" else self._choose(row, a)
        if a["field"] is not None:
            old, self.fields[a["field"]] = self.fields.get(a["field"]), a["value"]
            return f"{a['field'].replace('_', ' ').capitalize()}: {old or '—'} → {a['value'] or '—'}"
        if kind == "UPDATE_CLAIMS":
            self.claims = a["claims"]
            return f"Claims updated ({a['n_claims']})"
        if kind == "RESOLVE_BOTANICALS":
            return f"Resolved {sum(1 for i in self.ingredients.values() if i['botanical_name'])}/{len(self.ingredients)} botanical identities"
        if not self.ingredients:
            raise Rejected("Add at least one ingredient before confirming.")
        self.confirmed = True
        return "Formulation confirmed"

    def _add(self, a: dict[str, Any]) -> str:
        key, ident, plant = a["user_term"].lower(), a["ingredient_id"] or f"ing_{a['seq']}", a["botanical_name"]
        if ident in self.ingredients or (key and any(key in i["names"] for i in self.ingredients.values())):
            raise Rejected(f"{a['user_term']} is already in the formulation.")
        if plant and any(i["botanical_name"] == plant for i in self.ingredients.values()):
            raise Rejected(f"{a['user_term']} resolves to {plant}, which is already in the formulation.")
        self.ingredients[ident] = _named({"id": ident, "botanical_name": plant, **{k: a[k] for k in ("user_term", "quantity", "unit", "plant_part", "amount", "synonyms", "candidates")}})
        return f"Added {a['user_term']} ({a['amount']})"

    def _update(self, row: dict[str, Any], a: dict[str, Any]) -> str:
        """Takes over what is given; an empty plant part removes it, and another term has the identity that comes with it."""
        new = {k: a[k] for k in ("quantity", "unit") if a[k] is not None}
        if a["plant_part"] is not None:
            new["plant_part"] = a["plant_part"] or None
        if a["user_term"] and a["user_term"] != row["user_term"]:
            new["user_term"] = a["user_term"]
        if not new:
            raise Rejected("No change requested for that ingredient.")
        old, changed = row["amount"], list(new)
        if "user_term" in new and (a["botanical_name"] or json.loads(a["candidates"])):
            new |= {k: a[k] for k in ("botanical_name", "synonyms", "candidates")}
        row |= new
        if {"quantity", "unit"} & new.keys():
            q = row["quantity"]
            row["amount"] = "no quantity" if q is None else f"{int(q) if float(q).is_integer() else q} {row['unit'] or ''}".strip()
        _named(row)
        return f"{row['user_term']}: {old} → {row['amount']}" if {"quantity", "unit"} & set(changed) else f"Updated {row['user_term']} ({', '.join(changed)})"

    def _choose(self, row: dict[str, Any], a: dict[str, Any]) -> str:
        """One of the ingredient's candidates becomes its identity."""
        wanted = (a["botanical_name"] or "").lower()
        found = next((c for c in json.loads(row["candidates"]) if (c.get("botanical_name") or "").lower() == wanted), None)
        if found is None or not wanted:
            raise Rejected(f"{a['botanical_name'] or ''!r} is not one of the candidates for {row['user_term']!r}.")
        row |= {"botanical_name": found["botanical_name"], "synonyms": json.dumps(found.get("synonyms") or [])}
        _named(row)
        return f"Resolved {row['user_term']} as {row['botanical_name']}"


def _named(row: dict[str, Any]) -> dict[str, Any]:
    """The row with all names that it answers to."""
    row["names"] = {str(n).lower() for n in (row["id"], row["user_term"], row["botanical_name"], *json.loads(row["synonyms"])) if n}
    return row


def _taken(key: int, held: Formulation, actions: list[dict[str, Any]]) -> pd.DataFrame:
    rows = []
    for a in actions:
        status, summary = held.take(a)
        rows.append((key, a["seq"], status, held.version, summary, len(held.ingredients), held.snapshot()))
    return pd.DataFrame(rows, columns=["formulation_id", "seq", "status", "version", "summary", "n_ingredients", "snapshot"])


def _records(frame: pd.DataFrame) -> list[dict[str, Any]]:
    return frame.astype(object).where(frame.notna(), None).to_dict("records")


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Actions sorted by formulation and seq; only the state of the current formulation is held between batches."""
    current, held = None, Formulation()
    for frame in frames:
        for key, actions in frame.groupby("formulation_id", sort=False):
            if key != current:
                current, held = key, Formulation()
            yield _taken(key, held, _records(actions))


def replay_actions(actions: DataFrame) -> DataFrame:
    """One row an action: its status, the version after it and a snapshot.

    Every action depends on the one before, so a formulation's log is walked in
    order, batch by batch; a task holds one batch and one formulation's state, however
    long the log is.
    """
    return prepared(actions).repartition("formulation_id").sortWithinPartitions("formulation_id", "seq").mapInPandas(_fold, OUTPUT)


_ROW = "place long, user_term string, quantity double, unit string, plant_part string, botanical_name string, amount string, synonyms string, candidates string"
_ROW_FIELDS = ["user_term", "quantity", "unit", "plant_part", "botanical_name", "amount", "synonyms", "candidates"]


def _processor(first_seq: int):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Replay(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.head = handle.getValueState("head", "version long, confirmed boolean, claims string, next long, place long")
            self.fields = handle.getMapState("fields", "field string", "value string")
            self.rows = handle.getMapState("ingredients", "id string", _ROW)
            self.early = handle.getMapState("early", "seq long", "action string")

        def _load(self) -> tuple[Formulation, dict]:
            held = Formulation()
            held.next, self.place = first_seq, 0
            if not self.head.exists():
                return held, {}
            held.version, held.confirmed, held.claims, held.next, self.place = self.head.get()
            held.fields = {k[0]: v[0] for k, v in self.fields.iterator()}
            found = sorted(((v[0], k[0], v[1:]) for k, v in self.rows.iterator()), key=lambda r: r[0])
            for place, ident, values in found:
                held.ingredients[ident] = _named({"id": ident, "place": place, **dict(zip(_ROW_FIELDS, values))})
            return held, self._entries(held)

        def _entries(self, held: Formulation) -> dict:
            """What the maps hold; an ingredient keeps the place at which it was added."""
            for row in held.ingredients.values():
                if "place" not in row:
                    row["place"], self.place = self.place, self.place + 1
            return {("f", k): (v,) for k, v in held.fields.items()} | {("i", i): (r["place"], *[r[k] for k in _ROW_FIELDS]) for i, r in held.ingredients.items()}

        def _save(self, held: Formulation, before: dict) -> None:
            """Only entries that are new, changed or gone."""
            after = self._entries(held)
            for (kind, name), value in after.items():
                if before.get((kind, name)) != value:
                    (self.fields if kind == "f" else self.rows).updateValue((name,), value)
            for kind, name in before.keys() - after.keys():
                (self.fields if kind == "f" else self.rows).removeKey((name,))
            self.head.update((held.version, held.confirmed, held.claims, held.next, self.place))

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
            held, before = self._load()
            waiting: dict[int, dict[str, Any]] = {}
            stored = {k[0] for k in self.early.keys()}

            def due() -> list[dict[str, Any]]:
                """The actions whose turn it is."""
                found = []
                while held.next in waiting or held.next in stored:
                    if held.next in waiting:
                        found.append(waiting.pop(held.next))
                    else:
                        stored.remove(held.next)
                        found.append(json.loads(self.early.getValue((held.next,))[0]))
                        self.early.removeKey((held.next,))
                    held.next += 1
                return found

            def store() -> None:
                for seq, action in waiting.items():
                    self.early.updateValue((seq,), (json.dumps(action),))
                stored.update(waiting)
                waiting.clear()

            for frame in rows:
                waiting |= {int(a["seq"]): a | {"seq": int(a["seq"])} for a in _records(frame) if int(a["seq"]) >= held.next}
                actions = due()
                if actions:
                    yield _taken(key[0], held, actions)
                if len(waiting) > BUFFER:
                    store()
            store()
            self._save(held, before)

        def close(self) -> None:
            pass

    return Replay()


def replay_stream(actions: DataFrame, first_seq: int = 1) -> DataFrame:
    """The same over a stream whose ``seq`` counts each formulation's actions without gaps from ``first_seq`` on.

    The state store holds ingredients and fields entry by entry, and actions that come
    before their turn; those wait, so the log may be cut and mixed anywhere.  A
    repeated ``seq`` that was taken is left out.
    """
    return prepared(actions).groupBy("formulation_id").transformWithStateInPandas(statefulProcessor=_processor(first_seq), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def versions(replayed: DataFrame) -> DataFrame:
    """(formulation_id, version, snapshot fields) of every applied action."""
    shape = "struct<ingredients:array<struct<id:string,user_term:string,quantity:double,unit:string,plant_part:string,botanical_name:string>>,fields:map<string,string>,claims:array<string>,confirmed:boolean>"
    read = replayed.where("status = 'applied'").select("formulation_id", "version", F.from_json("snapshot", shape).alias("s"))
    status = F.transform("s.ingredients", lambda i: i.withField("identity_status", F.when(i["botanical_name"] != "", "confirmed").otherwise("insufficient_evidence")))
    return read.select("formulation_id", "version", status.alias("ingredients"), "s.fields", "s.claims", "s.confirmed")
