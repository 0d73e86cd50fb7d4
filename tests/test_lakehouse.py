"""From a landing tree with planted defects to the views."""

import json
import struct
import types
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalake.functions.text import vocabulary_or_word
from stratalake.plans import checks, model, recipes, views
from stratalake.sources import landing, seeds, sheets
from stratalake.sources.store import ColumnDrift, TableStore
from stratalake.streaming import feeds

UNIT = "511o Btl"


def photo(lon, lat):
    """A JPEG head with EXIF capture time and GPS position."""
    dms = lambda v: [(int(abs(v)), 1), (int(abs(v) * 60 % 60), 1), (round(abs(v) * 3600 % 60 * 100), 100)]
    taken = b"2024:11:25 05:00:00\x00"
    body = b"II*\x00" + struct.pack("<I", 8)
    exif_at, gps_at = 8 + 2 + 24 + 4, 8 + 2 + 24 + 4 + 18
    data_at = gps_at + 2 + 48 + 4
    body += struct.pack("<H", 2) + struct.pack("<HHII", 0x8769, 4, 1, exif_at) + struct.pack("<HHII", 0x8825, 4, 1, gps_at) + struct.pack("<I", 0)
    body += struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(taken), data_at) + struct.pack("<I", 0)
    lat_at, lon_at = data_at + len(taken), data_at + len(taken) + 24
    body += struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\x00" if lat < 0 else b"N\x00") + struct.pack("<HHII", 2, 5, 3, lat_at) + struct.pack("<HHI4s", 3, 2, 2, b"W\x00" if lon < 0 else b"E\x00") + struct.pack("<HHII", 4, 5, 3, lon_at) + struct.pack("<I", 0)
    body += taken + b"".join(struct.pack("<II", *x) for v in (lat, lon) for x in dms(v))
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\x00\x00" + body


def sheet_bytes(rows, path):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    xml = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="x"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{xml}</sheetData></worksheet>")
    with open(path, "rb") as f:
        return f.read()


HEADERS = recipes.resolved(model.RECIPES, "status_sheet")["headers"]
ROWS = [["title"], [], [*HEADERS, "Obs"], ["1ª Cia", "120", "100", "1", "0", "2", "8", "10", "56.1", "3", "4", "5", "6", "Fz", "note"], ["2a Cia", "90", "91", "0", "0", "0", "9", "9", None, "3", "4", "5", "6", "Mun 7,62"], []]


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    land = root / "landing"

    def put(name, content):
        path = land / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else json.dumps(content, ensure_ascii=False).encode())

    point = lambda lon, lat: {"type": "Point", "coordinates": [lon, lat]}
    positions = [{"id": f"p{i}", "hora": f"2024-11-25T{8 + i:02d}:00:00Z", "fracao": "1a Cia/511o Btl", "coordenadas": point(-45.0 + i / 1000, -22.7), "precisao_m": 5.5, "operacao": "Perseu", "ano": "2024"} for i in range(3)]
    put("perseu/c2a/posicao/h8.json", positions)
    put("perseu/c2a/posicao/again.json", positions)  # the same bytes under another name
    put("perseu/c2a/posicao/cut.json", b'[{"id": "p9", ')
    put("astray.json", {"id": 1})
    put("perseu/c2a/mcc/m.json", [{"id": "m1", "hora": "2024-11-25T09:00:00Z", "fracao": UNIT, "especie": "limite", "nome": "L1", "geometria": {"type": "LineString", "coordinates": [[-45, -22.7], [-45.1, -22.7]]}, "operacao": "Perseu", "ano": "2024"}, {"id": "m2", "hora": "2024-11-25T09:00:00Z", "fracao": UNIT, "especie": "campo de minas", "nome": "CM", "geometria": point(-45.0, -22.7), "operacao": "Perseu", "ano": "2024"}])
    report = lambda i, at, where, said: {"id": i, "data": at, "relator": f"Cap Cmt 1a Cia/{UNIT} - 123", "localizacao": where, "situacao": said, "operacao": "PERSEU_2024"}
    put("perseu/c2b/relato/r1.json", report(1, "25/11/2024 05:10:00", "22° 42' 00.0\" S, 45° 00' 00.0\" W", "vi cavalos na ponte"))
    put("perseu/c2b/relato/r2.json", report(2, "27/11/2024 20:30:00", "Sem localizacao", "tudo calmo"))
    put("perseu/c2b/incidente/i1.json", {"id": "i1", "data_hora": "2024-11-25T12:00:00Z", "descricao": "ponte na estrada interditada", "prioridade": "Alta", "localizacao_informada": "22° 42' 00.0\" S, 45° 00' 00.0\" W", "operacao": "PERSEU_2024"})
    put("perseu/c2b/incidente/i1.jpg", photo(-45.0, -22.7))
    sheet = sheet_bytes(ROWS, root / "s.xlsx")
    put("perseu/relper/d1.xlsx", sheet)
    put("perseu/relper/d1.json", {"operacao": "PERSEU_2024", "om_remetente": UNIT, "data_hora": "2024-11-25T12:00:00Z", "turno": "matutino"})
    put("perseu/relper/lonely.json", {"operacao": "PERSEU_2024", "om_remetente": UNIT, "data_hora": "2024-11-27T21:00:00Z", "turno": "vespertino"})
    put("perseu/relper/orphan.pdf", b"%PDF scanned")
    put("perseu/fogos/f1.pdf", b"%PDF /Font")
    put("perseu/fogos/f1.json", {"operacao": "PERSEU_2024", "origem": UNIT, "data_hora": "2024-11-25T09:00:00Z", "nr": "1"})
    # A scanned form from another day part, a scan of the sheet above, and a radio message.
    put("perseu/relper/scan.pdf", b"%PDF scanned too")
    put("perseu/relper/scan.json", {"operacao": "PERSEU_2024", "om_remetente": UNIT, "data_hora": "2024-11-25T11:30:00Z", "turno": "matutino"})
    put("perseu/relper/twin.pdf", b"%PDF twin")
    put("perseu/relper/twin.json", {"operacao": "PERSEU_2024", "om_remetente": UNIT, "data_hora": "2024-11-25T12:00:00Z", "turno": "matutino"})
    put("perseu/voz/v1.wav", b"RIFF")
    put("perseu/voz/v1.json", {"operacao": "PERSEU_2024", "hora_transmissao": "2024-11-25T08:20:00Z", "estacao": UNIT, "duracao_s": 5})
    store = TableStore(spark, f"file://{root}/tables")
    recipes.create_tables(spark, store, model)
    fill = lambda t, *rows: store.overwrite(t, spark.createDataFrame(list(rows), store.read(t).schema))
    fill("ref_operation", ("PERSEU_2024", "Perseu", "EXERCISE", datetime(2024, 11, 25, 3), datetime(2024, 12, 6, 2), "POLYGON((-45.3 -22.9, -44.7 -22.9, -44.7 -22.5, -45.3 -22.5, -45.3 -22.9))", "BTL"))
    fill("ref_unit", ("BTL", "Btl 511", UNIT, "UNIT", None), ("C1", "Cia 1", f"1a Cia/{UNIT}", "SUBUNIT", "BTL"), ("C2", "Cia 2", f"2a Cia/{UNIT}", "SUBUNIT", "BTL"), ("C3", "Cia 3", f"3a Cia/{UNIT}", "SUBUNIT", "BTL"))
    fill("ref_place", ("a", "Vila", "LOCALITY", "vila", "POINT(-45.001 -22.7)", 10.0), ("b", "BR-1 km 1", "ROAD_KM", None, "POINT(-45.2 -22.7)", 1.0), ("c", "BR-1 km 2", "ROAD_KM", None, "POINT(-45.3 -22.7)", 1.0), ("d", "Longe", "LOCALITY", "longe", "POINT(-44 -22)", 1.0))
    fill("ref_abbreviation", ("Fz", "Rifle", None, None), ("Fuz", "Rifleman", None, None))
    first = landing.ingest(spark, store, f"file://{land}", model.SOURCES, datetime(2024, 11, 28))
    files = {r.file_uri.rpartition("/")[2]: r.file_id for r in store.read("file_manifest").collect()}
    receipts = {r.origin_uri.rpartition("/")[2]: r.receipt_id for r in store.read("raw_receipt").collect()}
    content = spark.read.format("binaryFile").load(f"file://{land}/perseu/relper/d1.xlsx").select(F.lit(files["d1.xlsx"]).alias("file_id"), "content")
    grid = sheets.read_sheets(content).first().output_json
    # Headers as a scan reads them: words out of order, letters lost.
    printed = ["Informe Hora de", "Localizacao Observador do", "Lancamento do Som Cratera", "Hora Ativ", "As", "Bombardeada (5) Area F", "Qnt Tipo Armamento Ini e", "Classificacao Tiro Ini", "Qnt e Tipo Municao", "Clarao-Som seg", "Efeito Fogos"]
    fires = {"tabs": {"second": [["Nr", "Obs"], ["1", "x"]], "t": [printed, ["Obs 250515 NOV 24", *"bcde", "49999-48965", "2/Ob/Me", *"hij", "efeito"]]}}
    garbled = ["Fracao", "Erev", "Ef Pres", "Baixas Cmb", "Baixas N Cmb", "Evacuados", "Vtr Op", "Vtr Tota", "Comb %", "Sup Cl I", "Sup Cl III", "Sup Cl V", "Sup Cl VIII", "Nec Prio", "Agua L"]
    scan = {"tabs": {"t": [["RELPER"], garbled, ["10 Cia", "70", "60", "0", "0", "0", "7", "8", "50", "2", "2", "2", "2", "Fz", "900"]]}}
    at = datetime(2024, 11, 28)
    fill("extraction", ("e1", files["d1.xlsx"], None, None, "N", "sheet", None, "s1", grid, 0.1, "OK", at), ("e2", None, receipts["r1.json"], None, "Y", "llm", "m1", "s2", json.dumps({"type_code": "avistamento_inimigo", "priority_code": "alta"}), 0.1, "OK", at), ("e3", files["f1.pdf"], None, None, "Y", "ocr", "d1", "s3", json.dumps(fires), 0.1, "OK", at), ("e4", files["scan.pdf"], None, None, "Y", "ocr", "d1", "s3", json.dumps(scan), 0.1, "OK", at), ("e5", files["twin.pdf"], None, None, "Y", "ocr", "d1", "s3", json.dumps(scan), 0.1, "OK", at), ("e6", files["v1.wav"], None, None, "Y", "speech", "ear", "s4", json.dumps({"texto": "dois potros na vila"}), 0.1, "OK", at), ("e7", files["v1.wav"], None, "e6", "Y", "llm", "m1", "s5", json.dumps({"texto": "dois potros na vila", "codinome": None, "referencia_local": "Vila", "prioridade": "chuva"}), 0.1, "OK", at))
    return types.SimpleNamespace(store=store, land=f"file://{land}", first=first, root=root, files=files)


def test_ingest(spark, lake):
    f = lake.first
    assert (f["n_seen"], f["n_new_files"], f["n_rejected"]) == (21, 7, 2)
    assert f["n_new_receipts"] == 3 + 2 + 2 + 1 + 1 + 1 + 1 + 3
    assert f["n_seen"] == f["n_recorded"] + f["n_duplicate"] + f["n_lost"] and (f["n_duplicate"], f["n_lost"]) == (1, 0)
    assert {r.reason_code for r in lake.store.read("reject").collect()} == {"JSON_INVALID", "PATH_INVALID"}
    image = lake.store.read("file_manifest").where("modality_code = 'IMAGE'").first()
    assert image.captured_wkt == "POINT(-45.000000 -22.700000)" and image.captured_at == datetime(2024, 11, 25, 8)
    assert {r.file_uri.rpartition("/")[2]: r.is_scanned for r in lake.store.read("file_manifest").collect()} == {"i1.jpg": None, "d1.xlsx": None, "orphan.pdf": "Y", "f1.pdf": "N", "scan.pdf": "Y", "twin.pdf": "Y", "v1.wav": None}
    again = landing.ingest(spark, lake.store, lake.land, model.SOURCES)
    assert (again["n_new_files"], again["n_new_receipts"], again["n_rejected"]) == (0, 0, 0)
    assert lake.store.read("ingest_run").count() == 2
    # The resent batch has no row of its own: only opening it shows that its records are known.
    assert [r.path.rpartition("/")[2] for r in landing.pending_paths(landing.scan(spark, lake.land, model.SOURCES), lake.store).collect()] in (["again.json"], ["h8.json"])


def test_recipes_and_views(spark, lake):
    s = lake.store
    names = ["c2a_position", "c2a_measure", "c2b_report", "c2b_incident", "status_sheet", "status_scan", "fires_report", "voice_message"]
    done = {n: recipes.run(spark, s, n, model) for n in names}
    assert {n: d["events"] for n, d in done.items()} == {"c2a_position": 3, "c2a_measure": 2, "c2b_report": 2, "c2b_incident": 1, "status_sheet": 2, "status_scan": 1, "fires_report": 1, "voice_message": 1}
    ev = {r.source_record_code: r for r in s.read("event").collect()}
    assert ev["p0"].unit_code == "C1" and ev["p0"].operation_code == "PERSEU_2024" and ev["p0"].geometry_wkt == "POINT(-45.0 -22.7)"
    assert ev["m2"].type_code == "OBSTACLE" and ev["m2"].function_code == "PROTECTION" and ev["m1"].type_code == "MEASURE"
    assert ev["1"].type_code == "ENEMY_SIGHTING" and ev["1"].priority_code == "URGENT" and ev["1"].unit_code == "C1" and ev["1"].occurred_at == datetime(2024, 11, 25, 8, 10)
    assert ev["2"].type_code is None and ev["2"].geometry_wkt is None
    assert ev["i1"].geometry_wkt == "POINT(-45.000000 -22.700000)"
    fire = next(r for r in ev.values() if r.source_code == "FIRES")
    assert fire.occurred_at == datetime(2024, 11, 25, 8, 15) and fire.geometry_wkt.startswith("POINT(-45.0")
    voice = next(r for r in ev.values() if r.source_code == "VOICE")
    assert (voice.type_code, voice.priority_code, voice.geometry_wkt, voice.unit_code, voice.model_name) == ("SIGHTING", "HIGH", "POINT(-45.001 -22.7)", "BTL", "m1 <- ear")
    status = {r.strength_planned: r for r in s.read("unit_status").collect()}
    assert (status[70].form_version, status[120].form_version, status[70].fuel_pct, status[70].extra_json) == ("V2", "V1", 50, '{"Agua L":"900"}')
    assert status[120].need_text == "Rifle" and status[90].need_text == "Mun 7,62" and status[120].fuel_pct == 56 and status[120].extra_json == '{"Obs":"note"}'
    assert {r.unit_code for r in s.read("event").where("source_code = 'STATUS'").collect()} == {"C1", "C2"}
    # A second run changes nothing; nothing is pending.
    before = s.read("event").count()
    assert recipes.run(spark, s, "c2b_report", model)["obsolete"] == 0 and s.read("event").count() == before
    # That holds for the scan whose record also came as a sheet, and for messages that no model has read.
    assert all(set(recipes.pending(s, n, model).values()) == {0} for n in names)
    # Another line in a reference table needs a new revision; a note does not.
    noted = types.SimpleNamespace(**{k: getattr(model, k) for k in ("TABLES", "VOCABULARIES", "VIEWS")}, RECIPES=json.loads(json.dumps(model.RECIPES)))
    rule = next(iter(noted.RECIPES["c2b_report"]["rules"].values()))
    rule["note"] = "said in other words"
    recipe = lambda m, n: recipes.validate(m)[n]
    assert recipes.fingerprint(s, recipe(noted, "c2b_report"), noted) == recipes.fingerprint(s, recipe(model, "c2b_report"), model)
    known, units = recipes.fingerprint(s, recipe(model, "status_sheet"), model), s.read("ref_unit")
    assert recipes.content_digest(units.repartition(3)) == recipes.content_digest(units)
    version = s.append("ref_unit", units.limit(1))
    assert recipes.fingerprint(s, recipe(model, "status_sheet"), model) != known
    with pytest.raises(recipes.RevisionError):
        recipes.run(spark, s, "status_sheet", model)
    assert recipes.pending(s, "status_sheet", model)["other_rules"] > 0
    s.overwrite("ref_unit", s.read("ref_unit", version - 1))
    assert recipes.fingerprint(s, recipe(model, "status_sheet"), model) == known
    # Changed rules need a new revision; then the event that they no longer produce goes.
    changed = types.SimpleNamespace(**{k: getattr(model, k) for k in ("TABLES", "VOCABULARIES", "VIEWS")}, RECIPES=json.loads(json.dumps(model.RECIPES)))
    changed.RECIPES["c2a_position"]["rules"]["occurred_at"] = {"do": "iso", "of": "hora", "zone": "UTC"}
    changed.RECIPES["c2a_position"]["rules"]["source_record_code"] = {"do": "direct", "of": "hora"}
    with pytest.raises(recipes.RevisionError):
        recipes.run(spark, s, "c2a_position", changed)
    changed.RECIPES["c2a_position"]["revision"] = "2024-12-01"
    assert recipes.run(spark, s, "c2a_position", changed)["obsolete"] == 3
    assert s.read("event").count() == before
    out = views.refresh(spark, s, model)
    threat = {r.element_kind: r for r in s.read("view_terrain_threat").collect()}
    assert threat["ROAD"].geometry_wkt == "LINESTRING(-45.2 -22.7, -45.3 -22.7)"
    groups = s.read("view_terrain_threat").where("phase = 3").collect()
    assert len(groups) == 2 and all(g.n_events == 2 and g.n_sources == 2 for g in groups)
    fires = next(g for g in groups if g.weapon_kind)
    assert (fires.weapon_count, fires.weapon_kind, fires.weapon_calibre, fires.place_name) == (2, "Ob", "Me", "Vila")
    local = {r.element_name: r.n_events for r in s.read("view_terrain_threat").where("element_kind = 'LOCALITY'").collect()}
    assert local == {"Vila": 5, "Longe": 0}
    problems = sorted((r.problem_kind, r.unit_code, r.shift_code) for r in s.read("view_data_problems").collect())
    assert ("INCOMPLETE", "C3", "MORNING") in problems and ("NOT_RECEIVED", "BTL", "AFTERNOON") in problems
    assert {k for k, *_ in problems} == {"INCOMPLETE", "NOT_RECEIVED", "BROKEN", "FILE_WITHOUT_RECORD", "RECORD_WITHOUT_FILE"}
    picture = s.read("view_current_picture").collect()
    assert len({r.record_id for r in picture if r.panel_kind != "MEASURE"}) == len([r for r in picture if r.panel_kind != "MEASURE"])
    assert next(r for r in picture if r.element_name == "Cia 1" and r.panel_kind == "STATUS").strength_pct == 83.33
    series = {(r.indicator_code, str(r.period_at)[:10]): r.value for r in s.read("view_indicators").where("scope_code = 'THREAT_AND_INCIDENTS'").collect()}
    assert series[("THREAT_REPORTS", "2024-11-25")] == 1 and series[("THREAT_REPORTS", "2024-11-26")] == 0 and len(series) == 6
    assert {r.element_kind for r in s.read("view_terrain_threat").where("step_code = 'RESTRICTIONS'").collect()} == {"OBSTACLE", "INCIDENT"}
    inputs = sorted((r.phase, r.factor_code, r.input_kind, r.input_name, r.input_text) for r in s.read("view_planning_inputs").where("factor_code <> 'ENEMY' and input_kind not in ('STATUS', 'POSITION', 'LOCALITY')").fillna("-").collect())
    assert inputs == [
        (1, "MISSION", "AREA", "Perseu", "Area of responsibility of operation Perseu"),
        (1, "TIME", "PERIOD", "Perseu", "From 25/11/2024 00:00 to 05/12/2024 23:00"),
        (2, "CIVIL", "SIGHTING", "-", "dois potros na vila"),
        (2, "TERRAIN", "BOUNDARY", "L1", "Control measure"),
        (2, "TERRAIN", "INCIDENT", "-", "ponte na estrada interditada"),
        (2, "TERRAIN", "OBSTACLE", "CM", "Obstacle"),
        (2, "TERRAIN", "PLACE", "Longe", "LOCALITY"),
        (2, "TERRAIN", "PLACE", "Vila", "LOCALITY"),
        (2, "TERRAIN", "ROAD", "BR-1", "-"),
    ]
    assert out["view_indicators"].count() == 12
    tests = {r.name: r for r in checks.run(spark, s, model).collect()}
    assert len(tests) == 14 and tests["event_id_unique"].status == "Success" and tests["photo_where_it_says"].failing_rows == 0 and tests["reject_was_resent"].failing_rows == 2
    assert {r.source_code: r.rate for r in checks.preservation(s).collect()}["C2_A"] == 1.0
    assert checks.latency(s).count() > 0 and checks.footprint(s)["event"] > 0 and checks.profile(s, "event")[1].count() > 0
    event = json.loads(checks.lineage_event("status_scan", model, ["extraction"], ["event"]))
    assert {c["target"]: c for c in event["columns"]}["unit_code"]["sources"] == ["Fração"]


def test_store_versions(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/t")
    schema = spark.createDataFrame([], "k int, v string").schema
    s.create("x", schema)
    s.append("x", spark.createDataFrame([(1, "a")], schema))
    s.append("x", spark.createDataFrame([(2, "b")], schema))
    s.overwrite("x", s.read("x").withColumn("v", F.upper("v")))
    assert sorted(map(tuple, s.read("x").collect())) == [(1, "A"), (2, "B")]
    assert sorted(map(tuple, s.read("x", 3).collect())) == [(1, "a"), (2, "b")] and s.snapshots("x").count() == 4
    assert s.append_new("x", spark.createDataFrame([(2, "z"), (3, "c")], schema), ["k"], ["v"]) == 1
    with pytest.raises(ColumnDrift):
        s.create("x", spark.createDataFrame([], "k int").schema)
    assert s.maintain(keep=1, most_parts=1)["x"] == {"compacted": True, "expired": 5, "orphans": 4}
    assert s.read("x").count() == 3


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/t")
    schema = spark.createDataFrame([], "k string, v int").schema
    s.create("x", schema, "", ["k"], 16)
    s.append("x", spark.createDataFrame([(f"k{i}", i) for i in range(400)], schema))
    names = lambda: {f for f in s.read("x").inputFiles()}
    before, version = names(), s.manifest("x")["version"]
    s.upsert("x", spark.createDataFrame([("k7", -7), ("new", 1)], schema), ["k"], spark.createDataFrame([("k9",)], "k string"))
    kept = names() & before
    touched = {r[0] for r in spark.createDataFrame([("k7",), ("k9",), ("new",)], "k string").select(s._bucket(s.manifest("x")["buckets"])).collect()}
    assert len(kept) == 16 - len(touched) and all(f"_bucket={b}/" not in f for b in touched for f in kept)
    rows = {r.k: r.v for r in s.read("x").collect()}
    assert rows == {f"k{i}": i for i in range(400) if i not in (7, 9)} | {"k7": -7, "new": 1}
    assert {r.k for r in s.read("x", version).collect()} == {f"k{i}" for i in range(400)}
    assert s.expire("x", 1) and s.remove_orphans("x") == len(touched) and s.read("x").count() == 400
    with pytest.raises(ValueError, match="null"):
        s.upsert("x", spark.createDataFrame([(None, 1)], schema), ["k"])
    assert not s.compact("x") and s.upsert("x", spark.createDataFrame([], schema), ["k"]) and s.read("x").count() == 400


def test_comments_stay(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/t")
    recipes.create_tables(spark, s, model)
    s.overwrite("event", s.read("event"))
    found = {c: text for c, _, text in s.describe("event")}
    assert found[""].startswith("what all sources") and found["geometry_wkt"] == "WKT, longitude first" and set(found) - {""} == set(model.TABLES["event"])


def test_seed(spark, tmp_path):
    (tmp_path / "u.csv").write_text("# comment\nUNIDADE_COD,N\nA,1\nB,\nC,x\n")
    schema = spark.createDataFrame([], "unit_code string, n int, other string").schema
    assert [tuple(r) for r in seeds.load_seed(spark, f"file://{tmp_path}/u.csv", schema, {"UNIDADE_COD": "unit_code", "N": "n"}).collect()] == [("A", 1, None), ("B", None, None), ("C", None, None)]


def test_invalid_spec_lists_all():
    bad = types.SimpleNamespace(TABLES=model.TABLES, VOCABULARIES=model.VOCABULARIES, RECIPES={"x": {"source": "S", "revision": "1", "origin": "nowhere", "modality": "JSON", "folder": "/", "rules": {"nope": {"do": "direct"}, "type_code": {"do": "vocabulary", "vocabulary": "zz"}, "unit_code": {"do": "magic"}}}, "y": {"inherits": "y"}})
    with pytest.raises(recipes.SpecError) as e:
        recipes.validate(bad)
    assert all(w in str(e.value) for w in ("nowhere", "nope", "zz", "magic", "inherits from itself"))


def test_setting_lock(spark):
    settings = spark.createDataFrame([("v1", "other")], "setting_code string, content_hash string")
    with pytest.raises(recipes.RevisionError):
        recipes.lock_setting(settings, "v1", "t", "{}", "p")
    digest, new = recipes.lock_setting(settings, "v2", "t", "{}", "p")
    assert new and len(digest) == 64


def test_grid_by_position():
    opened = lambda *grid, **k: list(recipes.open_rows([*grid], ["Fração", "Ef Prev"], {"Ef Prev": ["Ef %"]}, True, **k))
    assert opened(["x"], ["Fracao", "Erev", None], ["1a", "5", "z"]) == [({"Fração": "1a", "Ef Prev": "5"}, {"column_3": "z"}, "V1")]
    assert opened(["Fracao", "Ef %", "Obs"], ["1a", "5", "z"]) == [({"Fração": "1a", "Ef Prev": "5"}, {"Obs": "z"}, "V2")]
    assert opened(["Fracao"], ["1a"]) == [] and opened(["a", "b"], ["c", "d"]) == []
    assert opened(["de Hora Informe", "zz"], ["1a", "5"], labels=["Informe de Hora", "Efeito"]) == [({"Fração": "1a", "Ef Prev": "5"}, {}, "V1")]
    assert recipes.alike("Bombardeada (5) Area F", "Area Bombardeada") == 1.0 and recipes.alike("Prev Ef", "Ef Prev") == 1.0 and recipes.alike("zzz", "Fração") < 0.75


def test_codewords(spark):
    said = {"tordilho": "POSITION", "potro": "SIGHTING", "cavalo": "ENEMY_SIGHTING", "brasa": "INCIDENT", "bigorna": "OBSTACLE", "martelo": "FIRE_MISSION", "tambor": "ENEMY_FIRE"}
    assert sorted(said) == sorted(model.CODEWORDS)
    rows = spark.createDataFrame([(w, f"tres {w}s na ponte", "tamborim") for w in said], "w string, plural string, other string")
    find = lambda c, t: vocabulary_or_word(F.col(c), model.VOCABULARIES["event_type"], F.col(t), model.CODEWORDS)
    got = {r.w: (r.a, r.b, r.c) for r in rows.select("w", find("w", "other").alias("a"), find("other", "plural").alias("b"), find("other", "other").alias("c")).collect()}
    assert got == {w: (t, t, None) for w, t in said.items()}


def test_streams(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/t")
    src = f"file://{tmp_path}/in"
    df = spark.createDataFrame([(1, 10, "2024-11-25 10:00:00"), (2, 10, "2024-11-25 10:05:00"), (3, 10, "2024-11-25 12:00:00")], "id long, u long, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(src)
    store.create("feed", df.schema)
    for _ in range(2):
        feeds.append_keyed(spark, store, src, "id long, u long, ts timestamp", "feed", ["id"], ["u"], f"file://{tmp_path}/c").awaitTermination(120)
        df.write.mode("append").parquet(src)
    assert store.read("feed").count() == 3
    q = feeds.sessions(spark.readStream.schema(df.schema).parquet(src), "u", "ts", "30 minutes", "1 minute").writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM sess").count() >= 1
