"""Domain metadata and classification, with values worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import refiners
from quillspark.operators import enrich, query_lang

CASES = [
    ("museum", "Era: late 19th\nMedium: oil on canvas\n", {"museum_era": "Late 19th", "museum_medium": "oil on canvas"}),
    ("museum", "Artist: Vincent van Gogh.\nPeriod: MEIJI ERA.", {"museum_artist": "Vincent van Gogh", "museum_era": "Meiji era"}),
    ("disaster", "TYPE: WILD FIRE.\n34.0522,-118.2437 urgency: immediate", {"disaster_incident_type": "Wild fire", "disaster_coordinates": "34.0522, -118.2437", "disaster_urgency": "Immediate"}),
    ("political", "Senator: José Núñez. vote: NAY, Donor: Österreich & Co.\n$1,000 and $20.50", {"political_candidate": "José Núñez", "political_vote": "Nay", "political_donors": ["Österreich & Co"], "political_contribution": 1000.0}),
    ("ai", "Model: Claude has 70   billion weights", {"ai_model_name": "Claude", "ai_param_count": "70 BILLION"}),
    ("spiritual", "see 1 John   4:8.", {"spiritual_book": "1 John", "spiritual_citation": "1 John 4:8"}),
    ("urban", "zone R 4B", {"urban_zoning_code": "R 4B"}),
    ("bio", "Experiment ID: ab-12 with NaCl", {"bio_exp_id": "AB-12", "bio_formulas": ["ID", "NaCl"], "bio_protocol": None}),
    ("cyber", "", {"cyber_cve_id": None, "cyber_all_cves": []}),
    ("cyber", "see cve-٢٠٢١-1234, CVE-2020-123; score ٩.٨\nSoftware: a, b ,,c", {"cyber_cve_id": "CVE-٢٠٢١-1234", "cyber_all_cves": ["CVE-٢٠٢١-1234"], "cyber_cvss_score": 9.8, "cyber_affected_sw": ["a", "b", "c"]}),
    ("auto", "1HGCM82633A004352 part ref: ab-1 P/N #ÄB REF XY", {"auto_vin": "1HGCM82633A004352", "auto_part_numbers": ["AB-1", "XY"]}),
    ("grant", "Opportunity: abc-123-x, $ 1,250.50 or $٣,٠٠٠\ndue: May ٣, 2021", {"grant_id": "abc-123-x", "grant_amount": 1250.5, "grant_deadline": "May ٣, 2021"}),
    ("grant", "$٣٠٠", {"grant_amount": 300.0, "grant_id": None}),
    ("mfg", "Ref: ab-12345 service:\nevery  ١٠ Days. fault ab-12 Code: x-1", {"mfg_part_number": "AB-12345", "mfg_maintenance_cycle": "every  ١٠ Days", "mfg_error_codes": ["AB-12"]}),
    ("edu", "Grade: k Subject: Él Arte-2\nngss-1.A", {"edu_grade_level": "K", "edu_subject": "Él Arte-2\nngss-1", "edu_standards": ["NGSS-1.A"]}),
    ("edu", "level  ١٢", {"edu_grade_level": "١٢"}),
    ("gaming", "v 1.٢.3b of Hero: Ana Bell. Agent: x", {"gaming_patch_version": "1.٢.3b", "gaming_characters": ["Ana Bell"]}),
    ("wellness", "٢٥٠ KCAL", {"wellness_calories": 250.0}),
    ("urban", "floor area ratio: ٢.٥; target is 9 units/acre.", {"urban_far_ratio": 2.5, "urban_density_target": "9 units/acre"}),
    ("disaster", "١٢.٣٤٥٦, -7.12345", {"disaster_coordinates": "١٢.٣٤٥٦, -7.12345"}),
    ("museum", "accession number #1987.12.3 MATERIAL: oil, wood\n", {"museum_accession_id": "1987.12.3", "museum_medium": "oil, wood"}),
    ("ai", "LLM: Orca-2 7. with 1.5 t", {"ai_model_name": "Orca-2 7", "ai_param_count": "1.5 T"}),
]


@pytest.mark.parametrize(("name", "content", "want"), CASES)
def test_rules(spark, name, content, want):
    row = spark.createDataFrame([(content,)], "content string").select(*refiners.domain(F.col("content"), name)).first().asDict()
    assert {k: row[k] for k in want} == want


def test_domains(spark):
    texts = {"Is this case law?": ["legal"], "my vault of D&D notes": ["pkm", "rpg"], "classified": ["tech"], "catalog of trees": ["genealogy", "cyber"], "nothing here": [], None: []}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", query_lang.domains(F.col("t")).alias("d"), query_lang.domain_scores(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["d"] for r in rows} == texts
    assert next(r["s"] for r in rows if r["t"] == "catalog of trees") == {"legal": 0, "tech": 0, "pkm": 0, "genealogy": 1, "rpg": 0, "cyber": 1}


def test_contradictions(spark):
    a = "the tower is open to all visitors today"
    pairs = {a: 0.0, "the tower is not open to all visitors today": 8 / 9 * 0.3, "the tower is closed to all visitors today": 0.0, "the tower is close to all visitors today": 7 / 9 * 0.2, "without the tower is open to all visitors today": 8 / 9 * 0.3, "something else": 0.0}
    rows = spark.createDataFrame([(a, b) for b in pairs], "a string, b string").select("b", enrich.contradiction(F.col("a"), F.col("b")).alias("s")).collect()
    assert {r["b"]: r["s"] for r in rows} == {b: round(s, 6) for b, s in pairs.items()}
