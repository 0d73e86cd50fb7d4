"""The five analytical views, each rewritten whole from the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions import geo, text, times
from stratalake.operators import quality, series, spatial
from stratalake.operators.sized import small
from stratalake.sources.store import TableStore

CONTRIBUTIONS = {
    "MISSION": "Frames the operation that is planned.",
    "TERRAIN": "Shows what the terrain, its ways and its obstacles mean for movement.",
    "CIVIL": "Shows what the people there mean for the operation.",
    "ENEMY": "Shows what the threat did, and where.",
    "POSITION": "Updates where own units stand.",
    "STATUS": "Updates the people, vehicles and supplies at hand.",
    "MEASURE": "Belongs on the overlay of the courses of action.",
    "ACTIVITY": "Sums up the threat's patterns for comparing courses of action.",
    "TIME": "Bounds the time there is.",
}
INDICATORS = {
    "STRENGTH": ("Strength present", "PCT", lambda: pct("strength_present", "strength_planned")),
    "VEHICLES": ("Vehicles ready", "PCT", lambda: pct("vehicles_ready", "vehicles_total")),
    "FUEL": ("Fuel", "PCT", lambda: F.col("fuel_pct")),
    "CLASS_I": ("Days of class I", "DAYS", lambda: F.col("class_i_days")),
    "CLASS_III": ("Days of class III", "DAYS", lambda: F.col("class_iii_days")),
    "CLASS_V": ("Days of class V", "DAYS", lambda: F.col("class_v_days")),
    "CLASS_VIII": ("Days of class VIII", "DAYS", lambda: F.col("class_viii_days")),
    "COMBAT_LOSSES": ("Combat losses so far", "COUNT", lambda: F.col("combat_losses")),
    "OTHER_LOSSES": ("Other losses so far", "COUNT", lambda: F.col("other_losses")),
    "EVACUATED": ("Evacuated at the time of the report", "COUNT", lambda: F.col("evacuated")),
    "THREAT_REPORTS": ("Threat activities of the day", "COUNT", None),
    "INCIDENT_REPORTS": ("Incidents of the day", "COUNT", None),
}


def pct(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.lit(100.0) * F.col(part) / F.col(whole), 2))


class Views:
    """The views of one store. Frames that several blocks use are kept while a view is built, and dropped by refresh()."""

    def __init__(self, store: TableStore, model):
        self.store, self.model, self.p = store, model, model.VIEWS
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist())
        return df

    def block(self, view: str, df: DataFrame, **values) -> DataFrame:
        columns = list(self.model.TABLES[view].items())
        return series.block(df, columns, **{"updated_at": F.current_timestamp()} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})

    def name(self, value: Column) -> Column:
        return text.shown(value, self.p["names"])

    def local(self, at: Column) -> Column:
        return times.local(at, self.p["zone"])

    # -------------------------------------------------------------- shared frames

    def events(self) -> DataFrame:
        return self.store.read("event").join(self.store.read("control_measure"), "event_id", "left")

    def operation(self) -> DataFrame:
        return self.store.read("ref_operation").agg(F.max("operation_code").alias("op"))

    def places(self) -> DataFrame:
        return self.store.read("ref_place").where(F.col("kind_code").isin(self.p["place_kinds"])).withColumn("at", geo.centre(F.col("geometry_wkt")))

    def located(self, events: DataFrame) -> DataFrame:
        return events.withColumn("at", geo.centre(F.col("geometry_wkt"))).where("at is not null")

    def near(self, events: DataFrame, places: DataFrame) -> DataFrame:
        """(event_id, near_name, near_kind, near_wkt, near_m): the nearest reference place of each located event."""
        pts = self.located(events.where(F.col("type_code").isin(self.p["placed_types"]))).select(F.col("event_id").alias("pid"), F.col("at.x").alias("plon"), F.col("at.y").alias("plat"))
        found = spatial.nearest(pts, places.select(F.col("place_code").alias("qid"), F.col("at.x").alias("qlon"), F.col("at.y").alias("qlat")))
        return found.join(small(places), found["qid"] == places["place_code"]).select(F.col("pid").alias("event_id"), F.col("place_name").alias("near_name"), F.col("kind_code").alias("near_kind"), F.col("geometry_wkt").alias("near_wkt"), F.col("dist_m").alias("near_m"))

    def facts(self, most: int = 60) -> Column:
        """Aggregate: the facts of a group in order of time, `30/11 SOURCE Kind: text`."""
        said = F.trim(F.regexp_replace(F.coalesce("measure_name", "report_text", "note"), r"\s+", " "))
        short = F.when(F.length(said) > most, F.concat(F.substring(said, 1, most), F.lit("…"))).otherwise(said)
        head = F.concat_ws(" · ", F.date_format(self.local(F.col("occurred_at")), "dd/MM"), "source_code", self.name(F.col("type_code")))
        return series.timeline(F.col("occurred_at"), F.concat_ws(": ", head, F.nullif(short, F.lit(""))))

    # -------------------------------------------------------------- terrain and threat

    def terrain_threat(self) -> DataFrame:
        v, p = "view_terrain_threat", self.p
        events, places, op = self.keep(self.events()), self.keep(self.places()), F.broadcast(self.operation())
        near = self.keep(self.near(events, places))
        threat = events.where(F.col("type_code").isin(p["threat_types"]))
        one = dict(operation_code=F.col("operation_code"), geometry_wkt=F.col("geometry_wkt"), begins_at=F.col("occurred_at"), unit_code=F.col("unit_code"), types_text=self.name(F.col("type_code")), model_name=F.col("model_name"), event_ids=F.array("event_id"))
        beside = dict(place_name=F.col("near_name"), place_kind=F.col("near_kind"), place_distance_m=F.round("near_m"))
        single = dict(n_events=1, n_sources=1, modalities_text=F.col("modality_code"))
        short = text.one_line(F.col("report_text"))
        with_near = lambda df: df.join(near, "event_id", "left")
        blocks = [
            self.block(v, places.where("kind_code in ('LANDMARK', 'LOCALITY')").join(op), phase=1, step_code="CHARACTERISTICS", element_kind="PLACE", element_name=F.col("place_name"), element_text=F.col("kind_code"), operation_code=F.col("op"), geometry_wkt=F.col("geometry_wkt")),
            self.block(v, self.store.read("ref_operation"), phase=1, step_code="CHARACTERISTICS", element_kind="AREA", element_name=F.col("operation_name"), operation_code=F.col("operation_code"), geometry_wkt=F.col("area_wkt"), begins_at=F.col("begins_at"), ends_at=F.col("ends_at"), unit_code=F.col("unit_code")),
            self.block(v, events.where("measure_kind = 'BOUNDARY'"), phase=1, step_code="ZONE", element_kind="BOUNDARY", element_name=F.col("measure_name"), **one),
            self._localities(v, events, places, op),
            self.block(v, with_near(events.where("type_code = 'SIGHTING'")), phase=2, step_code="CIVIL", element_kind="SIGHTING", element_text=short, **one, **beside, **single),
            self._roads(v, places, op),
            self.block(v, events.where("measure_kind = 'AXIS'"), phase=2, step_code="ACCESS", element_kind="AXIS", element_name=F.col("measure_name"), **one),
            self.block(v, with_near(events.where((F.col("type_code") == "OBSTACLE") | ((F.col("type_code") == "INCIDENT") & F.lower("report_text").rlike("|".join(p["blocking_words"]))))), phase=2, step_code="RESTRICTIONS", element_kind=F.col("type_code"), element_name=F.coalesce("measure_name", "measure_kind"), element_text=F.coalesce(F.col("note"), short), **one, **beside, **single),
            self._threats(v, threat, near, short),
            self._activity(v, threat, near),
        ]
        return series.stack(blocks)

    def _localities(self, v, events, places, op) -> DataFrame:
        local = places.where("kind_code = 'LOCALITY'")
        seen = self.located(events.where(~F.col("type_code").isin(self.p["not_local_types"])))
        pairs = spatial.within(seen.select(F.col("event_id").alias("pid"), F.col("at.x").alias("plon"), F.col("at.y").alias("plat")), local.select(F.col("place_code").alias("qid"), F.col("at.x").alias("qlon"), F.col("at.y").alias("qlat")), self.p["locality_radius_m"])
        met = pairs.select("qid", F.col("pid").alias("event_id")).join(seen, "event_id").groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("source_code").alias("nf"), F.collect_set("modality_code").alias("mods"), F.collect_set("type_code").alias("kinds"), F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"), F.array_sort(F.collect_list("event_id")).alias("ids"), self.facts().alias("facts"))
        rows = local.join(met, local["place_code"] == met["qid"], "left").join(op)
        none = F.array().cast("array<string>")
        return self.block(v, rows, phase=2, step_code="CIVIL", element_kind="LOCALITY", element_name=F.col("place_name"), element_text=F.col("facts"), operation_code=F.col("op"), geometry_wkt=F.col("geometry_wkt"), begins_at=F.col("lo"), ends_at=F.col("hi"), types_text=text.listing(F.col("kinds"), self.p["names"]), n_events=F.coalesce("n", F.lit(0)), n_sources=F.coalesce("nf", F.lit(0)), modalities_text=text.listing(F.col("mods")), event_ids=F.coalesce("ids", none))

    def _roads(self, v, places, op) -> DataFrame:
        marks = places.where("kind_code = 'ROAD_KM'").select(F.regexp_extract("place_name", "^(.*) km", 1).alias("road"), F.regexp_extract("place_name", r"km (\d+)", 1).try_cast("int").alias("km"), F.regexp_extract("geometry_wkt", r"POINT\((.*)\)", 1).alias("xy"))
        lines = marks.where("km is not null").groupBy("road").agg(F.array_sort(F.collect_list(F.struct("km", "xy"))).alias("marks"))
        return self.block(v, lines.join(op), phase=2, step_code="ACCESS", element_kind="ROAD", element_name=F.col("road"), operation_code=F.col("op"), geometry_wkt=F.concat(F.lit("LINESTRING("), F.array_join(F.transform("marks", lambda m: m["xy"]), ", "), F.lit(")")))

    def _threats(self, v, threat, near, short) -> DataFrame:
        c = self.p["corroboration"]
        asked = self.located(threat).select(F.col("event_id").alias("id"), F.col("source_code").alias("source"), F.col("modality_code").alias("modality"), F.col("occurred_at"), F.col("at.x").alias("lon"), F.col("at.y").alias("lat")).withColumnRenamed("occurred_at", "at")
        met = spatial.corroborate(asked, c["radius_m"], c["seconds"]).withColumnRenamed("id", "event_id")
        rows = threat.join(near, "event_id", "left").join(met, "event_id", "left")
        none = F.array().cast("array<string>")
        others, sources, mods = F.coalesce("others", none), F.coalesce("sources", none), F.coalesce("modalities", none)
        arms = lambda i: F.when(F.col("source_code") == "FIRES", text.weapon(F.col("report_text"), i))
        return self.block(
            v, rows, phase=3, step_code="THREAT", element_kind="THREAT", element_text=short, operation_code=F.col("operation_code"), geometry_wkt=F.col("geometry_wkt"), place_name=F.col("near_name"), place_kind=F.col("near_kind"), place_distance_m=F.round("near_m"), begins_at=F.col("occurred_at"), unit_code=F.col("unit_code"),
            types_text=self.name(F.col("type_code")), n_events=1 + F.size(others), n_sources=1 + F.size(sources), modalities_text=text.listing(F.concat(F.array("modality_code"), mods)), weapon_count=text.integer(arms(1)), weapon_kind=arms(2), weapon_calibre=arms(3), model_name=F.col("model_name"), event_ids=F.concat(F.array("event_id"), others),
        )

    def _activity(self, v, threat, near) -> DataFrame:
        when = self.local(F.col("occurred_at"))
        placed = threat.join(near, "event_id").withColumn("day", F.date_format(when, "dd/MM/yyyy")).withColumn("period", times.day_period(F.hour(when), self.p["periods"]))
        rows = placed.groupBy("near_name", "near_kind", "day", "period").agg(F.max("near_wkt").alias("wkt"), F.max("operation_code").alias("op"), F.count("*").alias("n"), F.countDistinct("source_code").alias("nf"), F.collect_set("modality_code").alias("mods"), F.collect_set("type_code").alias("kinds"), F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"), F.array_sort(F.collect_list("event_id")).alias("ids"), F.max("model_name").alias("m"), self.facts().alias("facts"))
        return self.block(v, rows, phase=4, step_code="ACTIVITY", element_kind="ACTIVITY", element_name=F.concat(F.col("near_name"), F.lit(" | "), F.col("day"), F.lit(" "), F.col("period")), element_text=F.col("facts"), operation_code=F.col("op"), geometry_wkt=F.col("wkt"), place_name=F.col("near_name"), place_kind=F.col("near_kind"), begins_at=F.col("lo"), ends_at=F.col("hi"), types_text=text.listing(F.col("kinds"), self.p["names"]), n_events=F.col("n"), n_sources=F.col("nf"), modalities_text=text.listing(F.col("mods")), model_name=F.col("m"), event_ids=F.col("ids"))

    # -------------------------------------------------------------- data problems

    def submissions(self) -> DataFrame:
        """(parent_code, day, shift_code, unit_code, operation_code): the unit rows that came in."""
        rows = self.store.read("event").join(self.store.read("unit_status").select("event_id", "shift_code"), "event_id").join(self.store.read("ref_unit").select("unit_code", "parent_code"), "unit_code")
        return rows.groupBy("parent_code", F.to_date(self.local(F.col("occurred_at"))).alias("day"), "shift_code", "unit_code").agg(F.max("operation_code").alias("operation_code"))

    def expected_units(self) -> DataFrame:
        """(parent_code, unit_code): who fills a line of the form: a unit's sub-units, or its direct parts where it has no sub-unit."""
        units = self.store.read("ref_unit")
        heads = units.where("echelon_code = 'UNIT'").select(F.col("unit_code").alias("parent_code"))
        parts = units.select("parent_code", "unit_code", "echelon_code").join(heads, "parent_code", "left_semi")
        with_sub = parts.where("echelon_code = 'SUBUNIT'").select("parent_code").distinct()
        direct = parts.join(with_sub, "parent_code", "left_anti")
        return parts.where("echelon_code = 'SUBUNIT'").unionByName(direct).select("parent_code", "unit_code")

    def data_problems(self) -> DataFrame:
        v = "view_data_problems"
        receipts, files, rejects = self.store.read("raw_receipt"), self.store.read("file_manifest"), self.store.read("reject")
        sent = self.keep(self.submissions())
        arrived = sent.groupBy("parent_code", "day", "shift_code").agg(F.max("operation_code").alias("operation_code"))
        # One row of shifts, one of the operation and one a day: sizes that the calendar bounds.
        wanted = sent.select("parent_code").distinct().join(small(series.calendar(sent, F.col("day")))).withColumn("shift_code", F.explode(F.array(*[F.lit(s) for s in self.p["shifts"]])))
        due = quality.missing(wanted, arrived, ["parent_code", "day", "shift_code"]).join(F.broadcast(sent.agg(F.max("operation_code").alias("op"))))
        lines = arrived.join(self.expected_units(), "parent_code")
        short = quality.missing(lines, sent, ["parent_code", "day", "shift_code", "unit_code"])
        unsent = rejects.join(receipts.select("origin_uri").unionByName(files.select(F.col("file_uri").alias("origin_uri"))).distinct(), "origin_uri", "left_anti")
        sheet = dict(source_code="STATUS", modality_code="SHEET")
        return series.stack([
            self.block(v, files.join(receipts.select("file_id").where("file_id is not null"), "file_id", "left_anti"), problem_kind="FILE_WITHOUT_RECORD", operation_code=F.col("operation_code"), modality_code=F.col("modality_code"), object_text=F.col("file_uri"), object_id=F.col("file_id"), rule_text="file_has_record"),
            self.block(v, receipts.where(F.col("source_code").isin(self.p["sources_with_files"]) & F.col("file_id").isNull()), problem_kind="RECORD_WITHOUT_FILE", operation_code=F.col("operation_code"), source_code=F.col("source_code"), modality_code=F.col("modality_code"), object_text=F.col("origin_uri"), object_id=F.col("receipt_id"), rule_text="record_has_file"),
            self.block(v, due, problem_kind="NOT_RECEIVED", operation_code=F.col("op"), unit_code=F.col("parent_code"), reference_date=F.col("day"), shift_code=F.col("shift_code"), rule_text="shift_received", **sheet),
            self.block(v, short, problem_kind="INCOMPLETE", operation_code=F.col("operation_code"), unit_code=F.col("unit_code"), reference_date=F.col("day"), shift_code=F.col("shift_code"), rule_text="all_units_reported", **sheet),
            self.block(v, unsent, problem_kind="BROKEN", object_text=F.col("origin_uri"), object_id=F.col("reject_id"), rule_text="reject_was_resent"),
        ])

    # -------------------------------------------------------------- planning inputs

    def _latest(self, df: DataFrame, *keys: str) -> DataFrame:
        return series.latest(df, ["operation_code", *keys], [F.desc("occurred_at"), F.desc("event_id")])

    def positions(self) -> DataFrame:
        own = self.store.read("event").where("type_code = 'POSITION' and unit_code is not null")
        return self._latest(own, "unit_code").join(small(self.store.read("ref_unit").select("unit_code", "unit_name")), "unit_code", "left")

    def statuses(self) -> DataFrame:
        own = self.store.read("event").join(self.store.read("unit_status"), "event_id").where("unit_code is not null")
        return self._latest(own, "unit_code").join(small(self.store.read("ref_unit").select("unit_code", "unit_name")), "unit_code", "left")

    def measures(self) -> DataFrame:
        own = self.store.read("event").join(self.store.read("control_measure"), "event_id")
        return self._latest(own, "unit_code", "measure_kind", "measure_name")

    def status_text(self) -> Column:
        n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
        return F.concat(F.lit("Strength "), n("strength_present"), F.lit("/"), n("strength_planned"), F.lit("; vehicles "), n("vehicles_ready"), F.lit("/"), n("vehicles_total"), F.lit("; fuel "), n("fuel_pct"), F.lit("%"))

    def planning_inputs(self) -> DataFrame:
        v, gold = "view_planning_inputs", self.keep(self.store.read("view_terrain_threat"))
        one = dict(operation_code=F.col("operation_code"), begins_at=F.col("occurred_at"), unit_code=F.col("unit_code"), n_events=1, n_sources=1, modalities_text=F.col("modality_code"), event_ids=F.array("event_id"))
        of_gold = dict(operation_code=F.col("operation_code"), geometry_wkt=F.col("geometry_wkt"), begins_at=F.col("begins_at"), ends_at=F.col("ends_at"), n_events=F.col("n_events"), n_sources=F.col("n_sources"), modalities_text=F.col("modalities_text"), event_ids=F.col("event_ids"))
        ops = self.store.read("ref_operation")
        of_op = dict(operation_code=F.col("operation_code"), begins_at=F.col("begins_at"), ends_at=F.col("ends_at"), unit_code=F.col("unit_code"), input_name=F.col("operation_name"))
        say = lambda k: F.lit(CONTRIBUTIONS[k])
        at = lambda c: F.date_format(self.local(F.col(c)), "dd/MM/yyyy HH:mm")
        said, unit = F.coalesce("element_text", "types_text"), dict(unit_code=F.col("unit_code"))
        # The operation's area is an input of phase 1 already.
        ground = gold.where("phase in (1, 2) and element_kind <> 'AREA'").withColumn("factor", F.when((F.col("step_code") == "CIVIL") | (F.col("element_kind") == "SIGHTING"), "CIVIL").otherwise("TERRAIN"))
        who = F.coalesce("unit_name", "unit_code")
        return series.stack([
            self.block(v, ops, phase=1, step_code="MISSION", factor_code="MISSION", input_kind="AREA", input_text=F.concat(F.lit("Area of responsibility of operation "), F.col("operation_name")), contribution_text=say("MISSION"), geometry_wkt=F.col("area_wkt"), **of_op),
            self.block(v, ops, phase=1, step_code="MISSION", factor_code="TIME", input_kind="PERIOD", input_text=F.concat(F.lit("From "), at("begins_at"), F.lit(" to "), at("ends_at")), contribution_text=say("TIME"), **of_op),
            self.block(v, ground, phase=2, step_code="SITUATION", factor_code=F.col("factor"), input_kind=F.col("element_kind"), input_name=F.col("element_name"), input_text=said, contribution_text=F.when(F.col("factor") == "CIVIL", say("CIVIL")).otherwise(say("TERRAIN")), **unit, **of_gold),
            self.block(v, gold.where("phase = 3"), phase=2, step_code="SITUATION", factor_code="ENEMY", input_kind=F.col("element_kind"), input_name=F.coalesce("place_name", "element_name"), input_text=said, contribution_text=say("ENEMY"), **unit, **of_gold),
            self.block(v, self.positions(), phase=2, step_code="SITUATION", factor_code="MEANS", input_kind="POSITION", input_name=who, input_text="Last known position.", contribution_text=say("POSITION"), geometry_wkt=F.col("geometry_wkt"), **one),
            self.block(v, self.statuses(), phase=2, step_code="SITUATION", factor_code="MEANS", input_kind="STATUS", input_name=who, input_text=self.status_text(), contribution_text=say("STATUS"), **one),
            self.block(v, self.measures().where(F.col("measure_kind").isin(self.p["planning_measures"])), phase=3, step_code="COURSES", factor_code="MANOEUVRE", input_kind=self.name(F.col("measure_kind")), input_name=F.col("measure_name"), input_text=F.col("note"), contribution_text=say("MEASURE"), geometry_wkt=F.col("geometry_wkt"), **one),
            self.block(v, gold.where("phase = 4"), phase=3, step_code="COURSES", factor_code="ENEMY", input_kind=F.col("element_kind"), input_name=F.col("element_name"), input_text=F.col("types_text"), contribution_text=say("ACTIVITY"), **of_gold),
        ])

    # -------------------------------------------------------------- current picture

    def threat_groups(self) -> DataFrame:
        """The threat rows, one for each set of corroborating events; the pairwise relation makes no chains."""
        gold = self.store.read("view_terrain_threat").where("phase = 3")
        once = series.same_sets(gold, ["operation_code"], "event_ids", [series.descending(F.col("n_sources")), series.descending(F.unix_micros("begins_at")), F.get("event_ids", F.lit(0))])
        return once.withColumn("record_id", F.sha2(F.array_join(F.array_sort("event_ids"), "|"), 256))

    def current_picture(self) -> DataFrame:
        v = "view_current_picture"
        # The clock of an operation is its newest event, not the wall's.
        clock = self.keep(self.store.read("event").groupBy("operation_code").agg(F.max("occurred_at").alias("reference_at")))
        timed = lambda df: df.join(small(clock), "operation_code")
        age = lambda at: F.round(F.timestamp_diff("SECOND", at, F.col("reference_at")) / F.lit(60.0), 1)
        recent = lambda at: at >= F.col("reference_at") - F.expr(f"interval {int(self.p['fact_hours'])} hours")
        one = dict(record_id=F.col("event_id"), operation_code=F.col("operation_code"), unit_code=F.col("unit_code"), occurred_at=F.col("occurred_at"), reference_at=F.col("reference_at"), age_minutes=age(F.col("occurred_at")), n_sources=1, modalities_text=F.col("modality_code"), model_name=F.col("model_name"), event_ids=F.array("event_id"))
        placed = dict(geometry_wkt=F.col("geometry_wkt"), priority_code=F.col("priority_code"))
        who = F.coalesce("unit_name", "unit_code")
        threats = timed(self.threat_groups()).where(recent(F.col("begins_at")))
        facts = timed(self.store.read("event").where(F.col("type_code").isin(self.p["fact_types"]))).where(recent(F.col("occurred_at"))).join(small(self.store.read("ref_unit").select("unit_code", "unit_name")), "unit_code", "left")
        kind = F.when(F.col("type_code") == "OBSTACLE", "OBSTACLE").otherwise("MEASURE")
        return series.stack([
            self.block(v, timed(self.positions()), panel_kind="POSITION", element_name=who, element_text="Last known position.", type_text=self.name(F.col("type_code")), **one, **placed),
            self.block(v, timed(self.statuses()), panel_kind="STATUS", element_name=who, element_text=self.status_text(), type_text=self.name(F.col("type_code")), strength_pct=pct("strength_present", "strength_planned"), vehicle_pct=pct("vehicles_ready", "vehicles_total"), fuel_pct=F.col("fuel_pct"), least_supply_days=F.least("class_i_days", "class_iii_days", "class_v_days", "class_viii_days"), need_text=F.col("need_text"), **one),
            self.block(v, threats, record_id=F.col("record_id"), panel_kind="THREAT", element_name=F.coalesce("place_name", "element_name"), element_text=F.col("element_text"), operation_code=F.col("operation_code"), unit_code=F.col("unit_code"), type_text=F.col("types_text"), occurred_at=F.col("begins_at"), reference_at=F.col("reference_at"), age_minutes=age(F.col("begins_at")), geometry_wkt=F.col("geometry_wkt"), n_sources=F.col("n_sources"), modalities_text=F.col("modalities_text"), model_name=F.col("model_name"), event_ids=F.col("event_ids")),
            self.block(v, facts, panel_kind="FACT", element_name=who, element_text=text.one_line(F.col("report_text")), type_text=self.name(F.col("type_code")), **one, **placed),
            self.block(v, timed(self.measures()), panel_kind=kind, element_name=F.coalesce("measure_name", "measure_kind"), element_text=F.col("note"), type_text=F.col("measure_kind"), **one, **placed),
        ])

    # -------------------------------------------------------------- indicators

    def indicators(self) -> DataFrame:
        v = "view_indicators"
        named = F.create_map(*[F.lit(x) for k, (n, _, _) in INDICATORS.items() for x in (k, n)])
        measured = F.create_map(*[F.lit(x) for k, (_, m, _) in INDICATORS.items() for x in (k, m)])
        shared = dict(indicator_code=F.col("indicator"), indicator_name=F.try_element_at(named, F.col("indicator")), measure_code=F.try_element_at(measured, F.col("indicator")), operation_code=F.col("operation_code"), period_at=F.col("period_at"), is_current=F.when(F.col("is_current"), "Y").otherwise("N"), value=F.col("value"), previous=F.col("previous"), variation=F.col("variation"), trend_code=F.col("trend"))
        wide = self.store.read("event").join(self.store.read("unit_status"), "event_id").where("unit_code is not null").withColumnRenamed("occurred_at", "period_at")
        rows = series.unpivot(wide, ["operation_code", "unit_code", "period_at", "event_id"], {k: c() for k, (_, _, c) in INDICATORS.items() if c}).where("value is not null")
        force = series.with_trend(rows, ["operation_code", "unit_code", "indicator"], ["period_at", "event_id"], "value", "period_at")
        own = self.store.read("event")
        threats = self.threat_groups().select("record_id", "operation_code", F.col("begins_at").alias("at"), F.lit("THREAT_REPORTS").alias("indicator"), F.explode("event_ids").alias("event_id"))
        incidents = own.where(F.col("type_code").isin(self.p["incident_types"])).select(F.col("event_id").alias("record_id"), "operation_code", F.col("occurred_at").alias("at"), F.lit("INCIDENT_REPORTS").alias("indicator"), "event_id")
        facts = threats.unionByName(incidents).withColumn("day", F.to_date(self.local(F.col("at")))).join(own.select("event_id", "source_code"), "event_id", "left")
        daily = facts.groupBy("operation_code", "day", "indicator").agg(F.countDistinct("record_id").cast("double").alias("value"), F.countDistinct("event_id").alias("n"), F.countDistinct("source_code").alias("nf"), F.array_sort(F.collect_set("event_id")).alias("ids"))
        # Days without any have a row with zero, so that a fall to nothing shows.
        days = series.calendar(own.where("operation_code is not null"), F.to_date(self.local(F.col("occurred_at"))), ["operation_code"]).withColumn("indicator", F.explode(F.array(F.lit("THREAT_REPORTS"), F.lit("INCIDENT_REPORTS"))))
        filled = days.join(daily, ["operation_code", "day", "indicator"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("period_at", F.col("day").cast("timestamp"))
        activity = series.with_trend(filled, ["operation_code", "indicator"], ["period_at"], "value", "period_at")
        none = F.array().cast("array<string>")
        return series.stack([
            self.block(v, force, scope_code="OWN_FORCE", nature_code="QUANTITATIVE", unit_code=F.col("unit_code"), n_events=1, n_sources=1, event_ids=F.array("event_id"), **shared),
            self.block(v, activity, scope_code="THREAT_AND_INCIDENTS", nature_code="QUANTITATIVE", n_events=F.coalesce("n", F.lit(0)), n_sources=F.coalesce("nf", F.lit(0)), event_ids=F.coalesce("ids", none), **shared),
        ])


ORDER = {"view_terrain_threat": "terrain_threat", "view_data_problems": "data_problems", "view_planning_inputs": "planning_inputs", "view_current_picture": "current_picture", "view_indicators": "indicators"}
SUMMARY = {"view_terrain_threat": ["phase", "step_code", "element_kind"], "view_data_problems": ["problem_kind"], "view_planning_inputs": ["phase", "factor_code"], "view_current_picture": ["panel_kind"], "view_indicators": ["indicator_code"]}


def refresh(spark: SparkSession, store: TableStore, model, only: list[str] | None = None) -> dict[str, DataFrame]:
    """Rewrites the views in their order of dependence; returns each one's counts by kind."""
    out = {}
    for view, method in ORDER.items():
        if only and view not in only:
            continue
        views = Views(store, model)
        try:
            store.overwrite(view, getattr(views, method)())
        finally:
            for df in views.kept:
                df.unpersist()
        out[view] = store.read(view).groupBy(*SUMMARY[view]).agg(F.count("*").alias("n")).orderBy(*SUMMARY[view])
    return out
