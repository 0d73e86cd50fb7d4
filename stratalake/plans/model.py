"""The canonical model: tables, vocabularies, recipes and view parameters. Everything that a deployment changes stands here, as data.

Recipes say how the records of one source become events. A rule names a transformation, where its value comes from (`of`: a payload field, a JSON path
beginning with `$`, or a cell; `sidecar`: a field of the record beside the file) and its parameters.
"""

from __future__ import annotations

TABLES: dict[str, dict[str, str]] = {
    "event": {
        "event_id": "string", "operation_code": "string", "source_code": "string", "source_record_code": "string", "modality_code": "string", "type_code": "string",
        "function_code": "string", "is_c2": "string", "occurred_at": "timestamp", "arrived_at": "timestamp", "latency_seconds": "double", "unit_code": "string", "geometry_wkt": "string",
        "precision_m": "double", "location_method_code": "string", "priority_code": "string", "report_text": "string", "receipt_id": "string", "file_id": "string",
        "extraction_id": "string", "model_name": "string", "recipe_hash": "string", "revision_code": "string",
    },
    "unit_status": {
        "event_id": "string", "shift_code": "string", "strength_planned": "int", "strength_present": "int", "combat_losses": "int", "other_losses": "int", "evacuated": "int",
        "vehicles_ready": "int", "vehicles_total": "int", "fuel_pct": "int", "class_i_days": "double", "class_iii_days": "double", "class_v_days": "double", "class_viii_days": "double",
        "need_text": "string", "form_version": "string", "extra_json": "string",
    },
    "control_measure": {"event_id": "string", "measure_kind": "string", "measure_name": "string", "note": "string"},
    "extraction": {
        "extraction_id": "string", "file_id": "string", "receipt_id": "string", "origin_extraction_id": "string", "is_inferred": "string", "tool_name": "string", "model_name": "string",
        "setting_code": "string", "output_json": "string", "seconds": "double", "status_code": "string", "run_at": "timestamp",
    },
    "extraction_setting": {"setting_code": "string", "tool_name": "string", "parameters_json": "string", "prompt_text": "string", "content_hash": "string", "recorded_at": "timestamp"},
    "ref_operation": {"operation_code": "string", "operation_name": "string", "kind_code": "string", "begins_at": "timestamp", "ends_at": "timestamp", "area_wkt": "string", "unit_code": "string"},
    "ref_unit": {"unit_code": "string", "unit_name": "string", "unit_label": "string", "echelon_code": "string", "parent_code": "string"},
    "ref_place": {"place_code": "string", "place_name": "string", "kind_code": "string", "reference_text": "string", "geometry_wkt": "string", "precision_m": "double"},
    "ref_abbreviation": {"abbreviation_code": "string", "term_name": "string", "synonym_text": "string", "origin_code": "string"},
    "view_terrain_threat": {
        "phase": "int", "step_code": "string", "element_kind": "string", "element_name": "string", "element_text": "string", "operation_code": "string", "geometry_wkt": "string",
        "place_name": "string", "place_kind": "string", "place_distance_m": "double", "begins_at": "timestamp", "ends_at": "timestamp", "unit_code": "string", "types_text": "string",
        "n_events": "int", "n_sources": "int", "modalities_text": "string", "weapon_count": "int", "weapon_kind": "string", "weapon_calibre": "string", "model_name": "string", "event_ids": "array<string>", "updated_at": "timestamp",
    },
    "view_data_problems": {
        "problem_kind": "string", "operation_code": "string", "source_code": "string", "modality_code": "string", "unit_code": "string", "reference_date": "date", "shift_code": "string",
        "object_text": "string", "object_id": "string", "rule_text": "string", "updated_at": "timestamp",
    },
    "view_planning_inputs": {
        "phase": "int", "step_code": "string", "factor_code": "string", "input_kind": "string", "input_name": "string", "input_text": "string", "contribution_text": "string", "operation_code": "string",
        "geometry_wkt": "string", "begins_at": "timestamp", "ends_at": "timestamp", "unit_code": "string", "n_events": "int", "n_sources": "int", "modalities_text": "string", "event_ids": "array<string>", "updated_at": "timestamp",
    },
    "view_current_picture": {
        "record_id": "string", "panel_kind": "string", "element_name": "string", "element_text": "string", "operation_code": "string", "unit_code": "string", "type_text": "string", "occurred_at": "timestamp",
        "reference_at": "timestamp", "age_minutes": "double", "geometry_wkt": "string", "priority_code": "string", "strength_pct": "double", "vehicle_pct": "double", "fuel_pct": "int",
        "least_supply_days": "double", "need_text": "string", "n_sources": "int", "modalities_text": "string", "model_name": "string", "event_ids": "array<string>", "updated_at": "timestamp",
    },
    "view_indicators": {
        "indicator_code": "string", "indicator_name": "string", "scope_code": "string", "nature_code": "string", "operation_code": "string", "unit_code": "string", "period_at": "timestamp", "is_current": "string",
        "value": "double", "measure_code": "string", "previous": "double", "variation": "double", "trend_code": "string", "n_events": "int", "n_sources": "int", "event_ids": "array<string>", "updated_at": "timestamp",
    },
}

#: what tables and columns hold; kept with the tables
COMMENTS: dict[str, dict[str, str]] = {
    "event": {
        "": "what all sources have in common: one row an observation", "event_id": "digest of source, record and time in UTC", "source_record_code": "the record's own identity at its source",
        "geometry_wkt": "WKT, longitude first", "latency_seconds": "from occurrence to arrival", "model_name": "models that inferred values, the last first", "recipe_hash": "digest of the rules that made the row", "revision_code": "recipe and its revision",
    },
    "unit_status": {"": "one row for each unit line of a periodic report", "extra_json": "columns that the form didn't foresee", "form_version": "V1 with all declared headers, else V2"},
    "control_measure": {"": "what only drawn measures have"},
    "extraction": {"": "one reading of a file or record by a tool", "origin_extraction_id": "the reading that this one read", "is_inferred": "Y if a model guessed"},
    "extraction_setting": {"": "parameters and prompt behind a setting's code", "content_hash": "a code stands for one content"},
    "view_terrain_threat": {"": "terrain, people, threat and its activity by place", "event_ids": "the events behind the row"},
    "view_data_problems": {"": "what came broken and what did not come"},
    "view_planning_inputs": {"": "what there is for planning, by phase and factor"},
    "view_current_picture": {"": "the latest state; the clock is the newest event of the operation"},
    "view_indicators": {"": "series by unit and by day with trends", "is_current": "Y on the last period of a series"},
}

SOURCES = {"c2a": "C2_A", "c2b": "C2_B", "relper": "STATUS", "fogos": "FIRES", "voz": "VOICE"}

#: canonical value -> synonyms. What sources write, and the codewords of the radio.
VOCABULARIES: dict[str, dict[str, list[str]]] = {
    "event_type": {
        "POSITION": ["posicao", "position", "tordilho"], "SIGHTING": ["avistamento", "potro"], "ENEMY_SIGHTING": ["avistamento_inimigo", "cavalo"], "INCIDENT": ["incidente", "brasa"],
        "OBSTACLE": ["obstaculo", "bigorna", "campo de minas", "cratera", "barreira", "fosso anticarro"],
        "MEASURE": ["mcc", "linha de fase", "zona de reuniao", "limite", "eixo de progressao", "ponto de controle", "objetivo", "linha de partida"],
        "FIRE_MISSION": ["missao_tiro", "martelo"], "ENEMY_FIRE": ["bombardeio_inimigo", "bombardeio", "tambor"], "UNIT_STATUS": ["situacao_unidade", "celeiro"],
    },
    "measure_kind": {
        "PHASE_LINE": ["linha de fase"], "START_LINE": ["linha de partida"], "BOUNDARY": ["limite"], "AXIS": ["eixo de progressao"], "ASSEMBLY_AREA": ["zona de reuniao"], "CHECK_POINT": ["ponto de controle"],
        "OBJECTIVE": ["objetivo"], "BARRIER": ["barreira"], "DITCH": ["fosso anticarro"], "MINEFIELD": ["campo de minas"], "CRATER": ["cratera"],
    },
    "priority": {
        "URGENT": ["urgente", "alta", "critica", "crítica", "imediato", "relampago", "relâmpago"], "HIGH": ["prioritario", "prioritário", "media", "média", "moderada", "chuva"], "ROUTINE": ["rotina", "baixa", "normal", "orvalho"],
    },
    "shift": {"MORNING": ["matutino", "manha", "manhã"], "AFTERNOON": ["vespertino", "tarde"]},
}

#: the codewords of the radio that may stand in a transcript instead of a type
CODEWORDS = ["tordilho", "potro", "cavalo", "brasa", "bigorna", "martelo", "tambor"]

#: headers as the forms print them
_FORM = {
    "strength_planned": "Ef Prev", "strength_present": "Ef Pres", "combat_losses": "Baixas Cmb", "other_losses": "Baixas N Cmb", "evacuated": "Evacuados", "vehicles_ready": "Vtr Op", "vehicles_total": "Vtr Total",
    "fuel_pct": "Comb Pctl", "class_i_days": "Sup Cl I", "class_iii_days": "Sup Cl III", "class_v_days": "Sup Cl V", "class_viii_days": "Sup Cl VIII",
}

RECIPES: dict[str, dict] = {
    "c2a_position": {
        "source": "C2_A", "revision": "2024-11-25", "origin": "payload", "folder": "/posicao/", "modality": "JSON",
        "rules": {
            "source_record_code": {"do": "direct", "of": "id"}, "occurred_at": {"do": "iso", "of": "hora"}, "geometry_wkt": {"do": "geojson", "of": "coordenadas"}, "precision_m": {"do": "direct", "of": "precisao_m"},
            "unit_code": {"do": "reference", "of": "fracao", "to": "ref_unit", "search": "exact"}, "operation_code": {"do": "reference", "of": ["operacao", "ano"], "to": "ref_operation", "search": "exact"},
            "type_code": {"do": "constant", "value": "POSITION"}, "function_code": {"do": "constant", "value": "MOVEMENT"}, "location_method_code": {"do": "constant", "value": "GPS"}, "is_c2": {"do": "derived"},
        },
    },
    "c2a_measure": {
        "source": "C2_A", "revision": "2024-11-25", "origin": "payload", "folder": "/mcc/", "modality": "JSON", "extension": "control_measure",
        "rules": {
            "source_record_code": {"do": "direct", "of": "id"}, "occurred_at": {"do": "iso", "of": "hora"}, "geometry_wkt": {"do": "geojson", "of": "geometria"},
            "unit_code": {"do": "reference", "of": "fracao", "to": "ref_unit", "search": "exact"}, "operation_code": {"do": "reference", "of": ["operacao", "ano"], "to": "ref_operation", "search": "exact"},
            "type_code": {"do": "vocabulary", "of": "especie", "vocabulary": "event_type"}, "function_code": {"do": "derived"}, "location_method_code": {"do": "constant", "value": "MANUAL"}, "is_c2": {"do": "derived"},
            "measure_kind": {"do": "vocabulary", "of": "especie", "vocabulary": "measure_kind"}, "measure_name": {"do": "direct", "of": "nome"}, "note": {"do": "direct", "of": "observacao"},
        },
    },
    "c2b_report": {
        "source": "C2_B", "revision": "2024-11-25", "origin": "payload", "folder": "/relato/", "modality": "TEXT", "inferred": ["type_code", "priority_code"],
        "rules": {
            "source_record_code": {"do": "direct", "of": "id"}, "occurred_at": {"do": "day_first", "of": "data", "zone": "-03:00"}, "geometry_wkt": {"do": "dms", "of": "localizacao"}, "report_text": {"do": "direct", "of": "situacao"},
            "unit_code": {"do": "reference", "of": "relator", "to": "ref_unit", "search": "contained"}, "operation_code": {"do": "reference", "of": "operacao", "to": "ref_operation", "search": "exact"},
            "type_code": {"do": "vocabulary", "of": "inferred.type_code", "vocabulary": "event_type"},
            "priority_code": {"do": "vocabulary", "of": "inferred.priority_code", "vocabulary": "priority"}, "location_method_code": {"do": "constant", "value": "MANUAL"}, "is_c2": {"do": "derived"},
        },
    },
    "c2b_incident": {
        "source": "C2_B", "revision": "2024-11-25", "origin": "payload", "folder": "/incidente/", "modality": "IMAGE",
        "rules": {
            "source_record_code": {"do": "direct", "of": "id"}, "occurred_at": {"do": "iso", "of": "data_hora"}, "geometry_wkt": {"do": "direct", "of": "file.captured_wkt"}, "report_text": {"do": "direct", "of": "descricao"},
            "operation_code": {"do": "reference", "of": "operacao", "to": "ref_operation", "search": "exact"}, "priority_code": {"do": "vocabulary", "of": "prioridade", "vocabulary": "priority"},
            "type_code": {"do": "constant", "value": "INCIDENT"}, "location_method_code": {"do": "constant", "value": "GPS"}, "is_c2": {"do": "derived"},
        },
    },
    "status_sheet": {
        "source": "STATUS", "revision": "2024-11-25", "origin": "grid", "folder": "/relper/", "modality": "SHEET", "extension": "unit_status", "headers": ["Fração", *_FORM.values(), "Nec Prio"], "spellings": {"Comb Pctl": ["Comb %"]},
        "rules": {
            "source_record_code": {"do": "derived", "sidecar": ["operacao", "om_remetente", "data_hora", "turno"], "cells": ["Fração"]}, "occurred_at": {"do": "iso", "sidecar": "data_hora"},
            "unit_code": {"do": "reference", "of": "Fração", "to": "ref_unit", "search": "prefix", "context": "om_remetente"}, "operation_code": {"do": "reference", "sidecar": "operacao", "to": "ref_operation", "search": "exact"},
            "type_code": {"do": "constant", "value": "UNIT_STATUS"}, "function_code": {"do": "constant", "value": "LOGISTICS"}, "is_c2": {"do": "derived"}, "shift_code": {"do": "vocabulary", "sidecar": "turno", "vocabulary": "shift"},
            **{target: {"do": "cell", "of": header} for target, header in _FORM.items()},
            "need_text": {"do": "abbreviation", "of": "Nec Prio"}, "form_version": {"do": "derived"}, "extra_json": {"do": "leftover"},
        },
    },
    "status_scan": {
        "inherits": "status_sheet", "modality": "PDF", "by_position": True, "yields_to": "status_sheet",
        "rules": {"unit_code": {"do": "reference", "of": "Fração", "to": "ref_unit", "search": "alike", "limit": 2, "context": "om_remetente"}, "location_method_code": {"do": "constant", "value": "OCR_COORD"}},
    },
    "fires_report": {
        "source": "FIRES", "revision": "2024-11-25", "origin": "grid", "folder": "/fogos/", "modality": "PDF", "by_position": True, "headers": ["col_A", "col_B", "col_C", "col_D", "col_E", "col_F", "col_G", "col_H", "col_I", "col_J", "col_L"],
        # What the form prints above its columns: it only finds the header row, as scans garble and reorder the words.
        "labels": [
            "Informe de Hora", "Localizacao do Observador", "Lancamento do Som ou Cratera", "Hora Ativ De", "As", "Area Bombardeada", "Qnt e Tipo de Armamento Ini", "Classificacao do Tiro Ini",
            "Qnt e Tipo de Municao Ini", "Clarao-Som segundos", "Efeito dos Fogos Ini",
        ],
        "rules": {
            "source_record_code": {"do": "derived", "sidecar": ["operacao", "origem", "data_hora", "nr"], "cells": ["col_A", "col_F"]}, "occurred_at": {"do": "date_time_group", "of": "col_A", "zone": "-03:00"},
            "geometry_wkt": {"do": "decametric", "of": "col_F"}, "unit_code": {"do": "reference", "sidecar": "origem", "to": "ref_unit", "search": "exact"}, "operation_code": {"do": "reference", "sidecar": "operacao", "to": "ref_operation", "search": "exact"},
            "report_text": {"do": "derived", "cells": ["col_G", "col_H", "col_I", "col_J", "col_L"]}, "type_code": {"do": "constant", "value": "ENEMY_FIRE"}, "function_code": {"do": "constant", "value": "FIRES"},
            "location_method_code": {"do": "constant", "value": "OCR_COORD"}, "is_c2": {"do": "derived"},
        },
    },
    "voice_message": {
        "source": "VOICE", "revision": "2024-11-25", "origin": "fields", "folder": "/voz/", "modality": "AUDIO",
        "rules": {
            "source_record_code": {"do": "derived", "sidecar": ["operacao", "hora_transmissao", "estacao"]}, "occurred_at": {"do": "iso", "sidecar": "hora_transmissao"}, "unit_code": {"do": "reference", "sidecar": "estacao", "to": "ref_unit", "search": "exact"},
            "operation_code": {"do": "reference", "sidecar": "operacao", "to": "ref_operation", "search": "exact"}, "geometry_wkt": {"do": "gazetteer", "of": "referencia_local"}, "report_text": {"do": "direct", "of": "texto"},
            "type_code": {"do": "vocabulary", "of": "codinome", "vocabulary": "event_type", "elsewhere": "texto", "words": CODEWORDS}, "priority_code": {"do": "vocabulary", "of": "prioridade", "vocabulary": "priority"},
            "location_method_code": {"do": "constant", "value": "GAZETTEER"}, "is_c2": {"do": "derived"},
        },
    },
}

VIEWS: dict[str, dict] = {
    "zone": "America/Sao_Paulo",
    # How values are shown; others are shown as they are.
    "names": {
        "POSITION": "Position", "SIGHTING": "Sighting", "ENEMY_SIGHTING": "Enemy sighting", "INCIDENT": "Incident", "OBSTACLE": "Obstacle", "MEASURE": "Control measure", "FIRE_MISSION": "Fire mission",
        "ENEMY_FIRE": "Enemy fire", "UNIT_STATUS": "Unit status", "PHASE_LINE": "Phase line", "START_LINE": "Start line", "BOUNDARY": "Boundary", "AXIS": "Axis of advance", "ASSEMBLY_AREA": "Assembly area",
        "CHECK_POINT": "Check point", "OBJECTIVE": "Objective", "BARRIER": "Barrier", "DITCH": "Anti-tank ditch", "MINEFIELD": "Minefield", "CRATER": "Crater", "LANDMARK": "Landmark", "LOCALITY": "Locality",
        "ROAD_KM": "Road km", "GRID": "Grid square", "NIGHT": "Night", "MORNING": "Morning", "AFTERNOON": "Afternoon", "EVENING": "Evening",
    },
    "threat_types": ["ENEMY_SIGHTING", "ENEMY_FIRE"],
    "placed_types": ["ENEMY_SIGHTING", "ENEMY_FIRE", "SIGHTING", "OBSTACLE", "INCIDENT"],
    "place_kinds": ["LANDMARK", "LOCALITY", "ROAD_KM"],
    "corroboration": {"radius_m": 2000, "seconds": 3600},
    "locality_radius_m": 1000,
    "not_local_types": ["POSITION", "UNIT_STATUS", "MEASURE"],
    # Words of a report that tell of restricted movement; the first only as a whole word.
    "blocking_words": ["\\bvia\\b", "pista", "estrada", "obstru", "atolad", "interromp", "capacidade reduzida"],
    "periods": [(6, "NIGHT"), (12, "MORNING"), (18, "AFTERNOON"), (24, "EVENING")],
    "shifts": ["MORNING", "AFTERNOON"],
    "sources_with_files": ["STATUS", "FIRES", "VOICE"],
    "planning_measures": ["PHASE_LINE", "START_LINE", "CHECK_POINT", "ASSEMBLY_AREA", "OBJECTIVE"],
    "fact_hours": 24,
    "fact_types": ["SIGHTING", "INCIDENT", "FIRE_MISSION"],
    "incident_types": ["INCIDENT"],
}
