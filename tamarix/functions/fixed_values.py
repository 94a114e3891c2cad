"""Values that decide results: word lists, markers, thresholds and policy pairs."""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------

#: Words without weight in matching, compared after normalisation.
STOPWORDS = (
    "a", "au", "aux", "avec", "de", "des", "du", "d", "en", "et", "la", "le", "les", "l", "pour", "sur", "un", "une", "dans", "ou",
    "autre", "autres", "assimile", "assimiles", "n", "c", "niveau", "cadre", "cadres", "moyen", "moyens", "specialise", "specialises",
)

STRICT_MINIMUM, RELATED_MINIMUM, RELATED_MAXIMUM, OFFICIAL_MINIMUM = 92.0, 70.0, 91.99, 96.0
STRUCTURED_TIER, FUZZY_TIER, FUZZY_RATIO, AUTOSELECT_MINIMUM = 800.0, 585.0, 0.85, 595.0
MAXIMUM_AGE_DAYS = 15
FIELD_WEIGHTS = {"job_name": 1.0, "specialty": 1.0, "listing_role": 1.0, "listing_title": 0.90, "grade": 0.72}

#: A job's role in its listing's title.
LISTING_ROLES = (
    r"\brecrutement d['’]?u?n?e?\s+(?P<role>.+?)(?:\s+annonce\b|$)",
    r"\brecrutement de\s+(?P<role>.+?)(?:\s+annonce\b|$)",
)
ACADEMIC_MARKERS = ("maître de conférences", "maitre de conferences", "أستاذ محاضر", "maître de conférence", "maitre de conference")
ACADEMIC_ID = "edu.prof_universitaire"
TRAINER_MARKERS = ("formateur", "formatrice")
TRAINER_ID = "edu.formateur_professionnel"

#: Words at which an employer's name begins in a role.
EMPLOYER_WORDS = (
    "Ministère", "Ministere", "Agence", "Université", "Universite", "Office", "Société", "Societe", "Province", "Préfecture", "Prefecture",
    "Région", "Region", "Institut", "École", "Ecole", "Centre", "Fondation", "Chambre",
)

#: specific profession, generic one that it replaces
DOMINANCE = (
    ("it.cybersecurite", "it.responsable_si"),
    ("it.base_donnees", "it.administrateur_systemes"),
    ("it.data_analyst", "it.data_scientist"),
    ("sales.communication", "management.charge_projet"),
    ("btp.chef_projet_genie_civil", "management.charge_projet"),
    ("admin.assistant_direction", "admin.secretaire"),
    ("sales.publicite", "sales.marketing"),
    ("sales.responsable_communication", "sales.communication"),
    ("industry.responsable_hse", "industry.qualite"),
)

DEVELOPER_TECHNICIAN = "it.technicien_developpement_informatique"
IT_TECHNICIAN = "it.technicien_informatique"
#: Professions for technicians only.
TECHNICIAN_ONLY = (
    DEVELOPER_TECHNICIAN,
    "agri.technicien_technico_commercial_horticole",
    "agri.technicien_hydraulique_irrigation",
    "agri.technicien_elevage_ruminants",
    "agri.technicien_gestion_entreprises_agricoles",
)
#: technician's profession, one that it replaces
TECHNICIAN_REPLACES = (
    (DEVELOPER_TECHNICIAN, "it.developpeur_logiciel"),
    ("agri.technicien_technico_commercial_horticole", "sales.commercial"),
    ("agri.technicien_technico_commercial_horticole", "agri.horticulture"),
    ("agri.technicien_gestion_entreprises_agricoles", "admin.gestionnaire"),
)
DEVELOPMENT_TRACKS = ("developpement informatique", "developpement numerique")

GENERIC_JOB_NAMES = ("agents", "agents d'execution", "agent de maitrise", "agents de maitrise", "cadres", "cadres experimentes", "cadres et ingenieurs", "responsables et cadres")
GENERIC_GRADES = (
    r"technicien de [34](?:eme|ème) grade(?: - echelle \d+)?",
    r"administrateur [23](?:eme|ème) grade(?: - echelle \d+)?",
    r"ingenieur d'etat 1er grade(?: - echelle \d+)?",
    r"adjoint administratif 2(?:eme|ème) grade",
    r"adjoint technique 2(?:eme|ème) grade",
)
ROLE_EXPECTATIONS = (
    ("responsable hse", "industry.responsable_hse"),
    ("chef de service communication", "sales.responsable_communication"),
    ("charge de publicite", "sales.publicite"),
    ("chargee de publicite", "sales.publicite"),
    ("assistant de direction", "admin.assistant_direction"),
    ("assistante de direction", "admin.assistant_direction"),
)
EMPLOYER_TRACES = ("agence", "ministere", "universite", "chambre", "province", "institut")
HORTICULTURE_TRACK = "technico commercial en production horticole"
HORTICULTURE_FORBIDDEN = ("sales.commercial", "admin.gestionnaire", "agri.horticulture", "it.developpeur_logiciel")

FRENCH_DATETIME = r"(\d{1,2})\s+([A-Za-zÀ-ÿ]+)\s+(\d{4})(?:\s*-\s*(\d{1,2}):(\d{2}))?"
MONTHS = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}
DETAIL_LABELS = {
    "spécialité": "specialties", "specialite": "specialties", "grade": "grade", "nombre de postes": "positions", "type de recrutement": "recruitment_type",
    "type de dépôt": "application_type", "type de depot": "application_type", "site de dépôt": "application_site", "site de depot": "application_site",
    "code du concours": "contest_code", "nom du poste": "job_name",
}
SCOPES = ("service_etat", "etab_publics", "collec")
DETAIL_PATH = r"^/fr/concours/details/([0-9a-fA-F-]{36})/?$"
LIST_PATH = "/fr/concours-liste"
ROBOTS_PATHS = (LIST_PATH, "/fr/concours/details/00000000-0000-0000-0000-000000000000")
#: What every request says of itself, besides the agent.
HEADERS = {"Accept-Language": "fr-MA,fr;q=0.9,en;q=0.6", "Accept": "text/html,application/xhtml+xml", "Connection": "keep-alive"}
#: Parameters of a listing page, besides stat (the scope) and page.
LISTING_PARAMS = {"corps": "0", "datePicker": "", "date_from": "", "date_to": "", "key_word": "", "procedure": "avis", "region": "0"}
RESULTS = r"([\d.\s]+)\s+Résultats?"
#: Listing pages in a row without a new link, after which a scope's crawl stops.
STAGNANT_PAGES = 3
#: Names of a taxonomy's files.
MARKET_FILE, OFFICIAL_FILE, RULES_FILE = "market_professions.json", "nap2014_professions.json", "context_rules.json"
PAGE_SIZE, GUARD_PAGES, MOST_OFFICIAL = 9, 12, 100_000

#: Conjunctive rules: any of each given list must be contained as a whole phrase.
CONTEXT_RULES = (
    {"id": "public.tech_gc", "profession_id": "btp.technicien_genie_civil", "grade_any": ["technicien"], "specialty_any": ["génie civil", "génie civil travaux"], "score": 99.0},
    {"id": "public.eng_gc", "profession_id": "btp.ingenieur_genie_civil", "grade_any": ["ingénieur", "ingenieur"], "specialty_any": ["génie civil"], "score": 99.0},
    {"id": "public.tech_info", "profession_id": "it.technicien_informatique", "grade_any": ["technicien"], "specialty_any": ["informatique"], "score": 99.0},
    {"id": "public.tech_si", "profession_id": "it.technicien_systemes_information", "grade_any": ["technicien"], "specialty_any": ["systèmes d'information", "systemes d'information", "développement des systèmes d'information", "developpement des systemes d'information"], "score": 99.0},
    {"id": "public.tech_network", "profession_id": "it.technicien_reseaux", "grade_any": ["technicien"], "specialty_any": ["réseaux", "reseaux"], "score": 99.0},
    {"id": "public.tech_support", "profession_id": "it.technicien_support", "grade_any": ["technicien"], "specialty_any": ["maintenance informatique"], "score": 99.0},
    {"id": "public.tech_urbanisme", "profession_id": "btp.technicien_architecture_urbanisme", "grade_any": ["technicien"], "specialty_any": ["urbanisme", "architecture"], "score": 99.0},
    {"id": "public.tech_electricite", "profession_id": "industry.technicien_electrique", "grade_any": ["technicien"], "specialty_any": ["électricité", "electricite"], "score": 99.0},
    {"id": "public.tech_electromeca", "profession_id": "industry.technicien_electromecanique", "grade_any": ["technicien"], "specialty_any": ["électromécanique", "electromecanique"], "score": 99.0},
    {"id": "public.eng_hydraulique", "profession_id": "btp.ingenieur_hydraulique", "grade_any": ["ingénieur", "ingenieur"], "specialty_any": ["génie hydraulique", "genie hydraulique", "génie rural", "genie rural"], "score": 99.0},
    {"id": "market.agent_maitrise_finance", "profession_id": "admin.agent_maitrise_gestion_finance", "job_name_any": ["agent de maitrise", "agent de maîtrise"], "specialty_any": ["gestion d'entreprise", "comptabilité", "comptabilite", "finance", "économie", "economie"], "score": 99.0},
)

#: Announcements and the professions that they must and must not get.
GOLDEN_CASES = (
    {
        "name": "generic_building_technician_is_not_drafter",
        "job": {"job_name": "Technicien en Bâtiment", "specialties": [], "listing_title": "Avis de recrutement", "grade": "Technicien"},
        "must_include": ["btp.technicien_batiment"],
        "must_exclude": ["btp.dessinateur_architectural", "btp.dessinateur_projeteur"],
    },
    {
        "name": "drawing_specialty_maps_to_architectural_drafter",
        "job": {"job_name": "", "specialties": ["Dessin de bâtiment"], "listing_title": "Avis de concours", "grade": "Technicien de 3ème grade"},
        "must_include": ["btp.dessinateur_architectural"],
        "must_exclude": [],
    },
    {
        "name": "architectural_drafter_title_maps_exactly",
        "job": {"job_name": "Dessinateur en bâtiment", "specialties": [], "listing_title": "Recrutement", "grade": "Technicien"},
        "must_include": ["btp.dessinateur_architectural"],
        "must_exclude": ["btp.technicien_batiment"],
    },
    {
        "name": "civil_engineering_technician_is_not_drafter",
        "job": {"job_name": "Technicien en génie civil", "specialties": ["Génie civil"], "listing_title": "Avis de concours", "grade": "Technicien"},
        "must_include": ["btp.technicien_genie_civil"],
        "must_exclude": ["btp.dessinateur_architectural"],
    },
    {
        "name": "developer_is_not_network_technician",
        "job": {"job_name": "Développeur informatique", "specialties": ["Développement informatique"], "listing_title": "Recrutement", "grade": ""},
        "must_include": ["it.developpeur_logiciel"],
        "must_exclude": ["it.technicien_reseaux", "it.administrateur_reseaux"],
    },
    {
        "name": "accountant_is_not_management_controller",
        "job": {"job_name": "Comptable", "specialties": ["Comptabilité"], "listing_title": "Recrutement", "grade": ""},
        "must_include": ["finance.comptable"],
        "must_exclude": ["finance.controleur_gestion"],
    },
    {
        "name": "management_controller_is_not_accountant",
        "job": {"job_name": "Contrôleur de gestion", "specialties": ["Contrôle de gestion"], "listing_title": "Recrutement", "grade": ""},
        "must_include": ["finance.controleur_gestion"],
        "must_exclude": ["finance.comptable"],
    },
    {
        "name": "nurse_is_not_doctor",
        "job": {"job_name": "Infirmier", "specialties": ["Soins infirmiers"], "listing_title": "Recrutement", "grade": ""},
        "must_include": ["health.infirmier"],
        "must_exclude": ["health.medecin_generaliste", "health.medecin_specialiste"],
    },
    {
        "name": "doctor_is_not_nurse",
        "job": {"job_name": "Médecin généraliste", "specialties": [], "listing_title": "Recrutement", "grade": ""},
        "must_include": ["health.medecin_generaliste"],
        "must_exclude": ["health.infirmier"],
    },
    {
        "name": "maitre_de_conferences_from_listing_title",
        "job": {"job_name": "", "specialties": ["Science économiques"], "listing_title": "Avis de concours de recrutement de Maître de conférences grade A - Echelle 11 Université Moulay Ismaïl - Meknès Annonce 1 poste Limite de dépôt : 8 Septembre 2026 Date du concours : 17 Septembre 2026", "grade": "Maître de conférences grade A - echelle 11"},
        "must_include": ["edu.prof_universitaire"],
        "must_exclude": [],
    },
    {
        "name": "generic_technicien_grade_without_specialty_stays_unclassified",
        "job": {"job_name": "", "specialties": [], "listing_title": "Avis de concours de recrutement de Technicien de 3ème grade - Echelle 9 Archives du Maroc Annonce Dépôt en ligne 1 poste Limite de dépôt : 28 Août 2026 Date du concours : 27 Septembre 2026", "grade": "Technicien de 3ème grade - echelle 9"},
        "must_include": [],
        "must_exclude": [],
        "allowed_ids": [],
    },
    {
        "name": "charge_contenu_is_not_hr",
        "job": {"job_name": "Chargé de contenu Francophone", "specialties": [], "listing_title": "Avis de concours de recrutement de Chargé de contenu Francophone Office de la Formation Professionnelle et de la Promotion du Travail Annonce 1 poste Limite de dépôt : 6 Septembre 2026", "grade": ""},
        "must_include": ["sales.charge_contenu"],
        "must_exclude": ["admin.rh"],
    },
    {
        "name": "specialized_formateur_is_not_it_operator",
        "job": {"job_name": "Formateur en Réseaux Informatiques-(Bac+5)", "specialties": [], "listing_title": "Avis de concours de recrutement de Formateur en Réseaux Informatiques-(Bac+5) Office de la Formation Professionnelle et de la Promotion du Travail Annonce 1 poste Limite de dépôt : 6 Septembre 2026", "grade": ""},
        "must_include": ["edu.formateur_professionnel"],
        "must_exclude": ["it.technicien_reseaux", "it.administrateur_reseaux"],
    },
)

#: Queries and what their suggestions must begin with and must not have.
SUGGESTION_CASES = (
    {"query": "assistante de direction", "top": "admin.assistant_direction", "forbidden": ["admin.secretaire"]},
    {"query": "responsable hse", "top": "industry.responsable_hse", "forbidden": ["industry.qualite"]},
    {"query": "chargé de publicité", "top": "sales.publicite", "forbidden": ["sales.marketing"]},
    {"query": "électricien", "forbidden": ["beauty.estheticien"]},
    {"query": "communication", "top": "sales.communication", "forbidden": ["it.telecom"]},
    {"query": "technicien", "top_label_prefix": "technicien"},
    {"query": "ingénieur", "top_label_prefix": "ingenieur"},
    {"query": "informatique", "top_label_contains": "informatique"},
    {"query": "comptablee", "top": "finance.comptable"},
)
#: query, professions that must be suggested
SUGGESTION_REQUIRED = (
    ("développement informatique", ("it.developpeur_logiciel", "it.technicien_developpement_informatique")),
)
#: query, professions that must come before the last one, if that is suggested
SUGGESTION_ORDER = (
    ("génie civil", ("btp.ingenieur_genie_civil", "btp.technicien_genie_civil"), "edu.formateur_professionnel"),
)
# --- End of fixed values ----------------------------------------------------
