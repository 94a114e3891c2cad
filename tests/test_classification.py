"""Announcements to professions, through the scoring rules and policies."""

import json

import pytest
from professions import market_json, official_json
from pyspark.sql import functions as F

from tamarix.api import Taxonomy, run_golden_audit
from tamarix.functions import fixed_values as V
from tamarix.operators import matching
from tamarix.operators import taxonomy as taxonomies
from tamarix.sources.schemas import as_jobs


@pytest.fixture(scope="module")
def tax(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("taxonomy")
    (d / "market_professions.json").write_text(json.dumps(market_json(), ensure_ascii=False), encoding="utf-8")
    (d / "nap2014_professions.json").write_text(json.dumps(official_json(), ensure_ascii=False), encoding="utf-8")
    (d / "context_rules.json").write_text(json.dumps({"rules": list(V.CONTEXT_RULES)}, ensure_ascii=False), encoding="utf-8")
    return Taxonomy(spark, str(d))


def job(name="", grade="", specialties=(), title=""):
    return {"job_name": name, "grade": grade, "specialties": list(specialties), "listing_title": title}


TECH = "Technicien de 3ème grade - echelle 9"
EXACT = [
    (job("Technicien en Bâtiment", "Technicien"), {"btp.technicien_batiment"}),
    (job("", "Technicien de 3ème grade", ["Dessin de bâtiment"]), {"btp.dessinateur_architectural"}),
    (job("Dessinateur en bâtiment", "Technicien"), {"btp.dessinateur_architectural"}),
    (job("Technicien en génie civil", "Technicien", ["Génie civil"]), {"btp.technicien_genie_civil"}),
    (job("Développeur informatique", "", ["Développement informatique"]), {"it.developpeur_logiciel"}),
    (job("Comptable", "", ["Comptabilité"]), {"finance.comptable"}),
    (job("Contrôleur de gestion", "", ["Contrôle de gestion"]), {"finance.controleur_gestion"}),
    (job("Infirmier", "", ["Soins infirmiers"]), {"health.infirmier"}),
    (job("Médecin généraliste"), {"health.medecin_generaliste"}),
    (job("", "Maître de conférences grade A - echelle 11", ["Science économiques"], "Avis de concours de recrutement de Maître de conférences grade A - Echelle 11 Université X Annonce 1 poste"), {"edu.prof_universitaire"}),
    (job("", TECH, [], "Avis de concours de recrutement de Technicien de 3ème grade - Echelle 9 Archives Annonce 1 poste"), set()),
    (job("Chargé de contenu Francophone", "", [], "Avis de recrutement de Chargé de contenu Francophone Office X Annonce 1 poste"), {"sales.charge_contenu"}),
    (job("Formateur en Réseaux Informatiques-(Bac+5)"), {"edu.formateur_professionnel"}),
    # rules join a grade and a specialty
    (job("", TECH, ["Génie civil"]), {"btp.technicien_genie_civil"}),
    (job("", "Ingénieur d'Etat 1er grade", ["génie civil"]), {"btp.ingenieur_genie_civil"}),
    (job("Agent de maîtrise"), set()),
    (job("Agent de maîtrise", "", ["Finance"]), {"admin.agent_maitrise_gestion_finance"}),
    (job("", TECH, ["Informatique", "Réseaux", "Urbanisme", "Électricité"]), {"it.technicien_informatique", "it.technicien_reseaux", "btp.technicien_architecture_urbanisme", "industry.technicien_electrique"}),
    (job("أستاذ محاضر", "", ["Génie civil"]), {"edu.prof_universitaire"}),
    (job("", "", ["هندسة كهربائية"]), {"industry.technicien_electrique"}),
    # specific professions replace generic ones
    (job("RSSI - Responsable sécurité des systèmes d'information"), {"it.cybersecurite"}),
    (job("Administrateur de bases de données"), {"it.base_donnees"}),
    (job("Data Analyst", "", ["data science"]), {"it.data_analyst"}),
    (job("Chargé de projet génie civil"), {"btp.chef_projet_genie_civil"}),
    (job("Chargé de projet communication"), {"sales.communication"}),
    (job("Responsable HSE"), {"industry.responsable_hse"}),
    (job("Assistante de direction"), {"admin.assistant_direction"}),
    (job("Technicien en gestion et maintenance"), {"operations.technicien_gestion_maintenance"}),
    (job("Gestionnaire Recrutement"), {"admin.rh"}),
    # technicians
    (job("", TECH, ["développement informatique"]), {"it.technicien_developpement_informatique"}),
    (job("", TECH, ["développement informatique", "gestion informatique"]), {"it.technicien_developpement_informatique", "it.technicien_informatique"}),
    (
        job("", TECH, ["Technico-commercial en production horticole", "Hydraulique rurale et irrigation", "Élevage des ruminants", "Gestion des entreprises agricoles", "Développement informatique"]),
        {"agri.technicien_technico_commercial_horticole", "agri.technicien_hydraulique_irrigation", "agri.technicien_elevage_ruminants", "agri.technicien_gestion_entreprises_agricoles", "it.technicien_developpement_informatique"},
    ),
    (job("Charpentiers en bois"), {"hcp.7115"}),
    (job("Agents"), set()),
    (job(), set()),
]


def test_exact_sets(tax):
    found = tax.classify_jobs([j for j, _ in EXACT])
    for (j, want), got in zip(EXACT, found, strict=True):
        assert {m["profession_id"] for m in got} == want, j
        for m in got:
            assert m["searchable"] and m["confidence"] in ("EXACT", "STRONG") and m["score"] >= 92


def test_pruned_to_nothing_does_not_fall_back(tax):
    # the only market match is for technicians, and the grade is none
    assert tax.classify_job(job("", "Administrateur", ["élevage des ruminants"])) == []


def test_related_is_never_searchable(tax):
    hints = tax.related_job_matches(job("Technicien en Bâtiment"))
    assert hints and all(not m["searchable"] and m["confidence"] == "RELATED" and 70 <= m["score"] <= 91.99 for m in hints)
    assert "btp.dessinateur_architectural" not in {m["profession_id"] for m in tax.classify_job(job("Technicien en Bâtiment"))}


def test_evidence_keeps_the_first_term(tax):
    m = tax.classify_job(job("Secrétaire"))[0]
    assert m["evidence"] == {"field": "job_name", "value": "Secrétaire", "matched_term": "Secrétaire", "raw_score": 100.0}


def test_autocomplete(tax):
    ids = lambda q, n=50: [r["profession_id"] for r in tax.autocomplete(q, n)]
    assert all(i.startswith("btp.") for i in ids("dessin"))
    assert ids("caricaturistes") == ["hcp.2651"]
    assert ids("comptablee")[0] == "finance.comptable"
    assert ids("communication")[0] == "sales.communication" and "it.telecom" not in ids("communication")
    assert "beauty.estheticien" not in ids("électricien")
    assert tax.autocomplete("RSSI")[0]["score"] == 1000
    assert {"it.developpeur_logiciel", "it.technicien_developpement_informatique"} <= set(ids("développement informatique"))
    assert ids("") == [] and ids("zzzz") == []
    assert tax.autocomplete("artisans")[0]["score"] == 920 - 90 if tax.autocomplete("artisans") else True


def test_lookups(tax):
    assert tax.exact_profession_ids("rssi") == ["it.cybersecurite"]
    assert [r["id"] for r in tax.diploma_professions("licence en COMPTABILITE")] == ["finance.comptable", "finance.controleur_gestion"]
    assert tax.profession("hcp.7115")["sector"] == "Groupe" and tax.profession("none") is None
    assert tax.resolve("RSSI") == ("it.cybersecurite", [])
    assert tax.resolve("comptablee")[0] is None  # 594.74 is below what selects by itself
    assert tax.resolve("controleur de gestionn")[0] == "finance.controleur_gestion"
    chosen, some = tax.resolve("technicien")
    assert chosen is None and len(some) == 8
    payload = tax.autocomplete_payload()
    assert payload["version"] == 2 and payload["official_count"] == 3 and payload["professions"][-1]["profession_id"] == "hcp.7115"


def test_golden_audit(tax):
    cases = [{"name": "ok", "job": job("Infirmier"), "must_include": ["health.infirmier"], "must_exclude": []}, {"name": "bad", "job": job("Infirmier"), "must_include": [], "must_exclude": ["health.infirmier"]}]
    report = run_golden_audit(tax, cases)
    assert (report["passed"], report["failed"]) == (1, 1)
    bad = next(c for c in report["cases"] if c["name"] == "bad")
    assert bad["forbidden"] == ["health.infirmier"] and bad["unexpected"] == ["health.infirmier"]


def test_values_are_compared_once(spark, tax, monkeypatch):
    """Equal to comparing every row; a value that a third of all rows have is dealt
    over parts."""
    monkeypatch.setattr(matching, "OFTEN", 40)
    grades = ["Technicien 3ème grade", "Comptable", "INFIRMIER  polyvalent", "Génie civil technicien"]
    rows = [(str(i), grades[0] if i % 3 == 0 else grades[1 + i % 3], "Infirmier" if i % 5 else f"Autre {i}") for i in range(300)]
    jobs = as_jobs(spark.createDataFrame(rows, "uuid string, grade string, job_name string"))
    terms = taxonomies.terms(tax.professions).persist()
    evidence = matching.evidence(jobs).persist()
    scores = {"strict": matching.strict_score(), "related": matching.related_score()}
    cols = ["uuid", "field_ord", "field", "value", "weight", "norm_term", *scores]
    every = matching.met(evidence, terms).withColumns(scores).filter(F.greatest(*scores) > 0)
    got = matching.scored(evidence, terms, **scores)
    want = sorted(map(str, every.select(cols).collect()))
    assert sorted(map(str, got.select(cols).collect())) == want and len(want) > 300
    values = evidence.select("value", "norm_value").distinct()
    assert matching.met(values, terms).count() * 20 < matching.met(evidence, terms).count()
    parts = matching.dictionary(evidence.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / 40).cast("int").alias("parts")), terms, **scores)
    assert parts.agg(F.max("parts")).first()[0] > 2
