"""Recipes compiled to DataFrames: raw receipts and extractions become events and their extensions."""

from __future__ import annotations

import copy
import difflib
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.functions import geo, text, times
from stratalake.operators import keyed, lookups
from stratalake.operators.sized import small
from stratalake.sources.store import TableStore

DOES = {"direct", "constant", "json", "cell", "iso", "day_first", "lat_lon", "vocabulary", "reference", "gazetteer", "abbreviation", "leftover", "derived", "geojson", "dms", "decametric", "date_time_group"}
SEARCHES = {"exact", "prefix", "contained", "alike"}
DERIVED = {"source_record_code", "is_c2", "form_version", "function_code", "report_text", "arrived_at"}
SYSTEM = {"event_id", "source_code", "modality_code", "arrived_at", "latency_seconds", "receipt_id", "file_id", "extraction_id", "model_name", "recipe_hash", "revision_code"}
INSIDE_C2 = ("C2_A", "C2_B")


class SpecError(ValueError):
    """All problems of a model, one a line."""


class RevisionError(RuntimeError):
    """A recipe changed and its revision did not."""


@dataclass
class Recipe:
    name: str
    source: str
    revision: str
    origin: str
    modality: str
    folder: str
    rules: dict[str, dict]
    extension: str | None = None
    headers: list[str] = field(default_factory=list)
    spellings: dict[str, list[str]] = field(default_factory=dict)
    by_position: bool = False
    labels: list[str] = field(default_factory=list)
    yields_to: str | None = None
    inferred: list[str] = field(default_factory=list)


def resolved(recipes: dict[str, dict], name: str, seen: tuple = ()) -> dict:
    """A recipe with what it inherits: rules are merged one by one, other settings replaced."""
    if name in seen:
        raise SpecError(f"{name}: inherits from itself")
    if name not in recipes:
        raise SpecError(f"{name}: no such recipe")
    own = copy.deepcopy(recipes[name])
    parent = own.pop("inherits", None)
    if not parent:
        return own
    base = resolved(recipes, parent, (*seen, name))
    return base | own | {"rules": base["rules"] | own.get("rules", {})}


def validate(model) -> dict[str, Recipe]:
    """The recipes of a model module, or a SpecError that lists every problem."""
    problems, out = [], {}
    for name in model.RECIPES:
        try:
            spec = resolved(model.RECIPES, name)
            recipe = Recipe(name=name, **spec)
        except (SpecError, TypeError) as e:
            problems.append(str(e) if isinstance(e, SpecError) else f"{name}: {e}")
            continue
        targets = set(model.TABLES["event"])
        if recipe.extension:
            if recipe.extension not in model.TABLES:
                problems.append(f"{name}: no table {recipe.extension}")
            targets |= set(model.TABLES.get(recipe.extension, {}))
        if recipe.origin not in ("payload", "fields", "grid"):
            problems.append(f"{name}: unknown origin {recipe.origin}")
        if recipe.yields_to and recipe.yields_to not in model.RECIPES:
            problems.append(f"{name}: yields to the unknown {recipe.yields_to}")
        for target, rule in recipe.rules.items():
            at, do = f"{name}.{target}", rule.get("do")
            if target not in targets:
                problems.append(f"{at}: no such column")
            if do not in DOES:
                problems.append(f"{at}: unknown transformation {do}")
            if do == "vocabulary" and rule.get("vocabulary") not in model.VOCABULARIES:
                problems.append(f"{at}: unknown vocabulary {rule.get('vocabulary')}")
            if do == "reference" and (rule.get("to") not in model.TABLES or rule.get("search") not in SEARCHES):
                problems.append(f"{at}: unknown reference {rule.get('to')} or search {rule.get('search')}")
            if do == "derived" and target not in DERIVED:
                problems.append(f"{at}: nothing derives this column")
        out[name] = recipe
    if problems:
        raise SpecError("\n".join(problems))
    return out


NOTES = {"note", "description", "remark"}  # what describes a rule and decides nothing


def _without_notes(value):
    if isinstance(value, dict):
        return {k: _without_notes(v) for k, v in value.items() if k not in NOTES}
    return [_without_notes(v) for v in value] if isinstance(value, list) else value


def content_digest(df: DataFrame) -> str:
    """Of a table's rows, in whatever order they lie: their number and the sum of their hashes."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), *df.columns).cast("decimal(38,0)")).alias("g")).first()
    return f"{r.n}:{r.h}:{r.g}"


def references(recipe: Recipe) -> list[str]:
    """The reference tables whose contents decide a recipe's results."""
    by_kind = {"gazetteer": "ref_place", "abbreviation": "ref_abbreviation", "decametric": "ref_operation"}
    return sorted({r["to"] if r["do"] == "reference" else by_kind[r["do"]] for r in recipe.rules.values() if r["do"] == "reference" or r["do"] in by_kind})


def expressions(recipe: Recipe, model) -> dict[str, str]:
    """The compiled expression of each rule, without the numbers that differ from one compilation to the next."""
    kinds = model.TABLES["event"] | (model.TABLES[recipe.extension] if recipe.extension else {})
    looked_up = {"reference", "gazetteer", "abbreviation", "decametric", "derived"}
    found = {}
    for target, rule in recipe.rules.items():
        raw = value_of(rule, recipe.spellings)
        column = raw if rule["do"] in looked_up else simple(rule, raw, kinds.get(target, "string"), model.VOCABULARIES, recipe.spellings)
        found[target] = re.sub(r"_\d+|#\d+", "", str(column))
    return found


def fingerprint(store: TableStore, recipe: Recipe, model) -> str:
    """Digest of what decides a recipe's results: the recipe without its revision and notes, its compiled expressions (which hold the vocabularies), and the contents of the
    reference tables that it looks up."""
    spec = {k: _without_notes(v) for k, v in vars(recipe).items() if k != "revision"}
    tables = {t: content_digest(store.read(t)) for t in references(recipe)}
    return hashlib.sha256(json.dumps({"recipe": spec, "expressions": expressions(recipe, model), "references": tables}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def check_revision(recipe: Recipe, digest: str, events: DataFrame) -> None:
    """Raises if events of this recipe's revision were made by other rules."""
    other = events.where((F.col("revision_code") == f"{recipe.name}@{recipe.revision}") & (F.col("recipe_hash") != digest)).limit(1).count()
    if other:
        raise RevisionError(f"{recipe.name}: the rules changed, the revision {recipe.revision} did not")


def lock_setting(settings: DataFrame, code: str, tool: str, parameters: str, prompt: str) -> tuple[str, bool]:
    """(digest, whether it is new) of an extraction setting; raises if the code stands for another content."""
    digest = hashlib.sha256(f"{tool}|{parameters}|{prompt}".encode()).hexdigest()
    known = settings.where(F.col("setting_code") == code).select("content_hash").limit(1).collect()
    if known and known[0][0] != digest:
        raise RevisionError(f"setting {code} stands for other content")
    return digest, not known


# ------------------------------------------------------------------ grids


def _label_words(text: str) -> set[str]:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return set(re.findall(r"[a-z0-9]{2,}", plain))


def alike(read: str, label: str) -> float:
    """Similarity of a read cell to a label: by letters in order, or by the share of the label's words that stand in the cell in whatever order."""
    a, b = re.sub(r"\s+", " ", read.strip().lower()), re.sub(r"\s+", " ", label.strip().lower())
    wanted = _label_words(label)
    return max(difflib.SequenceMatcher(None, a, b).ratio(), len(wanted & _label_words(read)) / len(wanted) if wanted else 0.0)


def open_rows(grid: list[list], headers: list[str], spellings: dict[str, list[str]], by_position: bool, labels: list[str] | None = None) -> Iterator[tuple[dict, dict, str]]:
    """(cells by declared header, other cells, form version) of the data rows of one tab.

    The header row is the first that holds at least half of the declared headers; by position, the first of whose cells half as many as there are columns are like some
    label (the printed labels, or the headers and their spellings). Columns by position take the headers in order, those beyond them keep what was read; a sheet with
    fewer columns isn't opened. Version V2 has a renamed column: by position, one that is more like another spelling than like its header; else, where a
    declared header is absent."""
    names = {s: h for h in headers for s in [h, *spellings.get(h, [])]}
    said = labels or list(names)
    text_of = lambda c: None if c is None or str(c).strip() == "" else str(c).strip()
    for i, row in enumerate(grid):
        cells = [text_of(c) for c in row]
        if by_position:
            if sum(1 for c in cells if c and max(alike(c, x) for x in said) >= 0.75) * 2 < len(headers):
                continue
            if len(cells) < len(headers):
                return
            columns = dict(enumerate(headers)) | {k: cells[k] or f"column_{k + 1}" for k in range(len(headers), len(cells))}
            renamed = [] if labels else [(c or "", h, s) for c, h in zip(cells, headers, strict=False) for s in spellings.get(h, [])]
            plain = not any(alike(c, s) > alike(c, h) for c, h, s in renamed)
        else:
            if sum(1 for h in headers if any(s in cells for s in [h, *spellings.get(h, [])])) * 2 < len(headers):
                continue
            columns = {k: names.get(c, c) for k, c in enumerate(cells) if c}
            plain = all(h in cells for h in headers)
        for data in grid[i + 1 :]:
            filled = {columns[k]: text_of(c) for k, c in enumerate(data) if k in columns and text_of(c) is not None}
            if filled:
                yield {h: v for h, v in filled.items() if h in headers}, {h: v for h, v in filled.items() if h not in headers}, "V1" if plain else "V2"
        return


def _open_grids(headers: list[str], spellings: dict, by_position: bool, labels: list[str]):
    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    tabs = json.loads(r.output_json)["tabs"]
                except (ValueError, KeyError, TypeError):
                    continue
                for grid in tabs.values():
                    rows += [(r.extraction_id, cells, rest, version) for cells, rest, version in open_rows(grid, headers, spellings, by_position, labels)]
            yield pd.DataFrame(rows, columns=["extraction_id", "cells", "rest", "form_version"])

    return run


# ------------------------------------------------------------------ origins


def origin(store: TableStore, recipe: Recipe) -> DataFrame:
    """The recipe's input in one shape: row, receipt_id, file_id, extraction_id, received_at, payload (JSON), sidecar and cells (maps), inferred (map), rest_json,
    form_version, model_name, captured_wkt."""
    receipts = store.read("raw_receipt").where((F.col("source_code") == recipe.source) & F.col("origin_uri").contains(recipe.folder))
    done = store.read("extraction").where("status_code = 'OK'")
    newest = lambda key: Window.partitionBy(key).orderBy(F.desc("run_at"), F.desc("extraction_id"))
    empty = F.lit(None).cast("map<string,string>")
    shape = ["row", "receipt_id", "file_id", "extraction_id", "received_at", "payload", "sidecar", "cells", "inferred", "rest_json", "form_version", "model_name", "captured_wkt"]
    null = F.lit(None).cast("string")
    if recipe.origin == "payload":
        last = done.where("receipt_id is not null").withColumn("n", F.row_number().over(newest("receipt_id"))).where("n = 1").select("receipt_id", "extraction_id", "output_json", F.when(F.col("is_inferred") == "Y", F.col("model_name")).alias("model_name"))
        files = store.read("file_manifest").select("file_id", "captured_wkt")
        out = receipts.join(last, "receipt_id", "left").join(files, "file_id", "left")
        kept = [F.col("receipt_id").alias("row"), "receipt_id", "file_id", "extraction_id", "received_at", F.col("content_json").alias("payload"), empty.alias("sidecar"), text.payload_map(F.col("content_json")).alias("cells"), text.payload_map(F.col("output_json")).alias("inferred"), null.alias("rest_json"), null.alias("form_version"), "model_name", "captured_wkt"]
        return out.select(*kept).select(*shape)
    of_kind = receipts.where(F.col("modality_code") == recipe.modality).select("receipt_id", "file_id", "received_at", text.payload_map(F.col("content_json")).alias("sidecar"))
    if recipe.yields_to:
        # What also came in the other form is left to it: the same sidecar in the other modality.
        other = store.read("raw_receipt").where((F.col("source_code") == recipe.source) & (F.col("modality_code") == "SHEET")).select("content_hash").distinct()
        twins = receipts.join(other, "content_hash", "left_semi").select("receipt_id")
        of_kind = of_kind.join(twins, "receipt_id", "left_anti")
    # Direct readings of a file and readings of readings age apart: a newer transcription doesn't make an interpretation old.
    read_by = F.col("origin_extraction_id").isNotNull() if recipe.origin == "fields" else F.col("origin_extraction_id").isNull()
    by_file = done.where(F.col("file_id").isNotNull() & read_by).withColumn("n", F.row_number().over(newest("file_id"))).where("n = 1").drop("n", "receipt_id")
    last = of_kind.join(by_file, "file_id")
    if recipe.origin == "fields":
        # A reading of a reading: the model that heard and the one that interpreted.
        first = done.select(F.col("extraction_id").alias("origin_extraction_id"), F.when(F.col("is_inferred") == "Y", F.col("model_name")).alias("first_model"))
        named = last.join(first, "origin_extraction_id", "left").withColumn("model_name", F.nullif(F.concat_ws(" <- ", F.when(F.col("is_inferred") == "Y", F.col("model_name")), "first_model"), F.lit("")))
        return named.select(F.col("receipt_id").alias("row"), "receipt_id", "file_id", "extraction_id", "received_at", null.alias("payload"), "sidecar", text.payload_map(F.col("output_json")).alias("cells"), empty.alias("inferred"), null.alias("rest_json"), null.alias("form_version"), "model_name", null.alias("captured_wkt")).select(*shape)
    opened = last.select("extraction_id", "output_json").distinct().mapInPandas(_open_grids(recipe.headers, recipe.spellings, recipe.by_position, recipe.labels), "extraction_id string, cells map<string,string>, rest map<string,string>, form_version string")
    opened = opened.withColumn("rest_json", text.leftover(F.col("rest"), [])).withColumn("key", F.sha2(F.to_json("cells"), 256))
    rows = last.select("receipt_id", "file_id", "extraction_id", "received_at", "sidecar", F.when(F.col("is_inferred") == "Y", F.col("model_name")).alias("model_name")).join(opened, "extraction_id")
    return rows.select(F.concat_ws("|", "receipt_id", "key").alias("row"), "receipt_id", "file_id", "extraction_id", "received_at", null.alias("payload"), "sidecar", "cells", empty.alias("inferred"), "rest_json", "form_version", "model_name", null.alias("captured_wkt")).select(*shape)


# ------------------------------------------------------------------ rules


def value_of(rule: dict, spellings: dict[str, list[str]]) -> Column:
    """The raw text that a rule reads."""
    if "sidecar" in rule and isinstance(rule["sidecar"], str):
        return F.try_element_at("sidecar", F.lit(rule["sidecar"]))
    of = rule.get("of")
    if of is None:
        return F.lit(None).cast("string")
    if isinstance(of, list):
        return text.composed(*[value_of({"of": x}, spellings) for x in of])
    if of == "file.captured_wkt":
        return F.col("captured_wkt")
    if of.startswith("inferred."):
        return F.try_element_at("inferred", F.lit(of.removeprefix("inferred.")))
    if of.startswith("$"):
        return F.get_json_object("payload", of)
    return text.first_of(*[F.try_element_at("cells", F.lit(x)) for x in [of, *spellings.get(of, [])]])


def simple(rule: dict, raw: Column, kind: str, vocabularies: dict, spellings: dict) -> Column:
    """The column of a rule that needs no reference table."""
    do = rule["do"]
    if do == "constant":
        return F.lit(rule["value"])
    if do in ("direct", "json", "cell"):
        return text.integer(raw) if kind == "int" else raw.try_cast(kind) if kind != "string" else raw
    if do == "iso":
        return times.iso(raw, rule.get("zone") == "UTC")
    if do == "day_first":
        return times.day_first(raw, rule.get("pattern", "dd/MM/yyyy HH:mm:ss"), rule.get("zone"))
    if do == "date_time_group":
        return times.date_time_group(raw, rule.get("zone", "+00:00"))
    if do == "lat_lon":
        return geo.point(F.get_json_object("payload", rule["lon"]).try_cast("double"), F.get_json_object("payload", rule["lat"]).try_cast("double"))
    if do == "geojson":
        return geo.geojson_wkt(raw)
    if do == "dms":
        return geo.dms_point(raw)
    if do == "leftover":
        return F.col("rest_json")
    if do == "vocabulary":
        values = vocabularies[rule["vocabulary"]]
        return text.vocabulary_or_word(raw, values, value_of({"of": rule["elsewhere"]}, spellings), rule.get("words", [])) if "elsewhere" in rule else text.vocabulary(raw, values)
    raise SpecError(f"no column for {do}")


def compiled(store: TableStore, recipe: Recipe, model, digest: str | None = None) -> DataFrame:
    """All columns of event, and of the extension where there is one, for each row of the recipe's origin."""
    kinds = model.TABLES["event"] | (model.TABLES[recipe.extension] if recipe.extension else {})
    df = origin(store, recipe)
    raws = {t: value_of(r, recipe.spellings) for t, r in recipe.rules.items()}
    df = df.withColumns({f"raw_{t}": c for t, c in raws.items()})
    for target, rule in recipe.rules.items():
        raw, do = F.col(f"raw_{target}"), rule["do"]
        if do == "reference":
            refs = store.read(rule["to"])
            key = "unit_label" if rule["to"] == "ref_unit" else refs.columns[0]
            value = refs.columns[0]
            search = rule["search"]
            if search == "exact":
                df = lookups.exact(df, raw, small(refs), F.col(key), F.col(value), target)
                continue
            context = F.try_element_at("sidecar", F.lit(rule["context"])) if rule.get("context") else None
            asked = df.select("row", raw.alias("t"), (context if context is not None else F.lit(None).cast("string")).alias("c"))
            if search == "prefix":
                found = lookups.prefix_unique(asked, "row", F.col("t"), refs, F.col(key), F.col(value), F.col("c"))
            elif search == "contained":
                found = lookups.contained_longest(asked, "row", F.col("t"), refs, F.col(key), F.col(value))
            else:
                found = lookups.most_alike(asked, "row", F.col("t"), refs, F.col(key), F.col(value), rule.get("limit", 2), F.col("c"))
            df = df.join(found.withColumnRenamed("value", target), "row", "left")
        elif do == "gazetteer":
            places = store.read("ref_place").where(F.lit(True) if "kind" not in rule else F.col("kind_code") == rule["kind"])
            names = places.groupBy(F.lower(F.trim("reference_text")).alias("_k")).agg(F.max("geometry_wkt").alias(target))
            df = df.withColumn("_t", F.lower(F.trim(raw))).join(small(names), F.col("_t") == F.col("_k"), "left").drop("_t", "_k")
        elif do == "abbreviation":
            df = lookups.dictionary(df, raw, small(store.read("ref_abbreviation")), F.col("abbreviation_code"), F.col("term_name"), target)
        elif do == "decametric":
            areas = store.read("ref_operation").select(F.col("operation_code").alias("_o"), F.col("area_wkt").alias("_a"))
            df = df.withColumn("_s", F.try_element_at("sidecar", F.lit("operacao"))).join(small(areas), F.col("_s") == F.col("_o"), "left")
            df = df.withColumn(target, geo.decametric_point(raw, F.col("_a"))).drop("_s", "_o", "_a")
        elif do != "derived":
            df = df.withColumn(target, simple(rule, raw, kinds.get(target, "string"), model.VOCABULARIES, recipe.spellings))
    for target, rule in recipe.rules.items():
        if rule["do"] == "derived":
            df = df.withColumn(target, derived(target, rule, recipe, df.columns))
    stamp = F.date_format(times.local(F.col("occurred_at"), "UTC"), "yyyy-MM-dd HH:mm:ss") if "occurred_at" in df.columns else F.lit(None).cast("string")
    df = df.withColumns({
        "source_code": F.lit(recipe.source), "modality_code": F.lit(recipe.modality), "arrived_at": F.col("received_at"),
        "recipe_hash": F.lit(digest or fingerprint(store, recipe, model)), "revision_code": F.lit(f"{recipe.name}@{recipe.revision}"), "event_id": text.event_id(F.lit(recipe.source), F.col("source_record_code"), stamp),
    })
    if "occurred_at" in df.columns:
        df = df.withColumn("latency_seconds", F.timestamp_diff("SECOND", F.col("occurred_at"), F.col("arrived_at")).cast("double"))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def derived(target: str, rule: dict, recipe: Recipe, columns: list[str]) -> Column:
    cells = [F.try_element_at("cells", F.lit(c)) for c in rule.get("cells", [])]
    if target == "source_record_code":
        unit = [F.col("unit_code")] if "unit_code" in columns and recipe.origin == "grid" and recipe.extension else []
        return F.concat_ws("-", *[F.try_element_at("sidecar", F.lit(c)) for c in rule.get("sidecar", [])], *unit, *cells)
    if target == "is_c2":
        return F.lit("Y" if recipe.source in INSIDE_C2 else "N")
    if target == "form_version":
        return F.col("form_version")
    if target == "function_code":
        return F.when(F.col("type_code") == "OBSTACLE", "PROTECTION").otherwise("MOVEMENT")
    if target == "arrived_at":
        return F.col("received_at")
    return F.concat_ws(" | ", *cells)


def plan_text(store: TableStore, name: str, model) -> str:
    """The plan of a recipe, for reading."""
    return compiled(store, validate(model)[name], model)._jdf.queryExecution().toString()


def columns_of(recipe: Recipe, model) -> list[dict]:
    """Column lineage: what each target column of a recipe is made from."""
    return [{"target": t, "transformation": r["do"], "sources": [x for k in ("of", "sidecar", "cells") for x in ([r[k]] if isinstance(r.get(k), str) else r.get(k) or [])], "reference": r.get("to")} for t, r in recipe.rules.items()]


# ------------------------------------------------------------------ running


BUCKETS = 16  # of the event tables


def create_tables(spark: SparkSession, store: TableStore, model, buckets: int = BUCKETS) -> None:
    """Creates the model's tables; those by event have buckets, so that a run of a recipe writes only those buckets anew in which its events lie."""
    comments = getattr(model, "COMMENTS", {})
    for name, columns in model.TABLES.items():
        schema = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items())).schema
        known = comments.get(name, {})
        for f in schema:
            if f.name in known:
                f.metadata = {"comment": known[f.name]}
        store.create(name, schema, known.get("", ""), ["event_id"] if next(iter(columns)) == "event_id" else None, buckets)


def run(spark: SparkSession, store: TableStore, name: str, model) -> dict:
    """Runs a recipe: removes events of its receipts that are no longer produced, then upserts events and extension. Returns counts and, for each vocabulary column, its nulls."""
    recipe = validate(model)[name]
    digest = fingerprint(store, recipe, model)
    check_revision(recipe, digest, store.read("event"))
    produced = compiled(store, recipe, model, digest).persist()
    try:
        keyed.check_keys(produced, ["event_id"])
        events = produced.select(*model.TABLES["event"])
        mine = store.read("event").where(F.col("revision_code").startswith(recipe.name + "@"))
        gone = keyed.pending(mine.join(produced.select("receipt_id").distinct(), "receipt_id", "left_semi").select("event_id"), events, ["event_id"])
        n_gone = gone.count()
        if recipe.extension:
            store.upsert(recipe.extension, produced.select(*model.TABLES[recipe.extension]), ["event_id"], gone, f"upsert {name}")
        store.upsert("event", events, ["event_id"], gone, f"upsert {name}")
        checked = [t for t, r in recipe.rules.items() if r["do"] == "vocabulary"]
        counts = produced.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in checked]).first().asDict()
        return {"events": counts.pop("n"), "obsolete": n_gone, "unmatched": counts}
    finally:
        produced.unpersist()


def pending(store: TableStore, name: str, model) -> dict[str, int]:
    """Work that a run of the recipe would do, counted over the very rows that a run takes in: inputs without an event (a scan that also came as a sheet, or a message that
    no model has interpreted yet, is none), events older than the first interpretation of their input, events not on its newest extraction, and events of other rules."""
    recipe = validate(model)[name]
    events = store.read("event").where(F.col("revision_code").startswith(recipe.name + "@"))
    inputs = origin(store, recipe).select("receipt_id", F.col("extraction_id").alias("newest")).distinct()
    met = events.join(inputs, "receipt_id").agg(
        F.count_if(F.col("extraction_id").isNull() & F.col("newest").isNotNull()).alias("before"),
        F.count_if(F.col("extraction_id").isNotNull() & ~F.col("extraction_id").eqNullSafe(F.col("newest"))).alias("older"),
    )
    r = met.first()
    return {
        "without_event": keyed.pending(inputs.select("receipt_id").distinct(), events, ["receipt_id"]).count(),
        "older_than_interpretation": r.before,
        "older_extraction": r.older,
        "other_rules": events.where(~F.col("recipe_hash").eqNullSafe(F.lit(fingerprint(store, recipe, model)))).count(),
    }


def pending_extractions(store: TableStore, modality: str, setting: str, of: str = "files", of_setting: str | None = None) -> DataFrame:
    """What a setting hasn't read: file_id, receipt_id, origin_extraction_id, uri, content; of files (uri), of receipts, or of readings by another setting (content)."""
    done = store.read("extraction").where((F.col("setting_code") == setting) & (F.col("status_code") == "OK"))
    null = F.lit(None).cast("string")
    files = store.read("file_manifest").where(F.col("modality_code") == modality)
    if of == "files":
        left = keyed.pending(files, done, ["file_id"])
        return left.select("file_id", null.alias("receipt_id"), null.alias("origin_extraction_id"), F.col("file_uri").alias("uri"), null.alias("content"))
    if of == "receipts":
        own = store.read("raw_receipt").where(F.col("modality_code") == modality)
        return keyed.pending(own, done, ["receipt_id"]).select(null.alias("file_id"), "receipt_id", null.alias("origin_extraction_id"), F.col("origin_uri").alias("uri"), F.col("content_json").alias("content"))
    if of != "readings":
        raise ValueError(f"no such inputs: {of}")
    first = store.read("extraction").where((F.col("setting_code") == of_setting) & (F.col("status_code") == "OK")).join(files.select("file_id"), "file_id", "left_semi")
    left = keyed.pending(first.withColumn("origin_extraction_id", F.col("extraction_id")), done, ["origin_extraction_id"])
    return left.select("file_id", null.alias("receipt_id"), "origin_extraction_id", null.alias("uri"), F.col("output_json").alias("content"))
