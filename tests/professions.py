"""A taxonomy for tests: our own terms for the profession ids that the rules name."""

MARKET = {
    "admin.agent_maitrise_gestion_finance": ("Agent de maîtrise gestion et finance", []),
    "admin.assistant": ("Assistant administratif", ["assistante administrative"]),
    "admin.assistant_direction": ("Assistant de direction", ["assistante de direction"]),
    "admin.gestionnaire": ("Gestionnaire", ["gestion des entreprises", "gestionnaire administratif"]),
    "admin.rh": ("Responsable ressources humaines", ["gestion des ressources humaines", "gestionnaire recrutement", "chargé de recrutement"]),
    "admin.secretaire": ("Secrétaire", ["secrétaire de direction", "assistante de direction"]),
    "agri.horticulture": ("Horticulteur", ["production horticole"]),
    "agri.technicien_agricole": ("Technicien agricole", []),
    "agri.technicien_elevage_ruminants": ("Technicien en élevage des ruminants", ["élevage des ruminants"]),
    "agri.technicien_gestion_entreprises_agricoles": ("Technicien en gestion des entreprises agricoles", ["gestion des entreprises agricoles"]),
    "agri.technicien_hydraulique_irrigation": ("Technicien en hydraulique rurale et irrigation", ["hydraulique rurale et irrigation"]),
    "agri.technicien_technico_commercial_horticole": ("Technicien technico-commercial en production horticole", ["technico commercial en production horticole"]),
    "auto.electricien": ("Électricien automobile", ["électricité automobile"]),
    "auto.mecanicien": ("Mécanicien automobile", ["mécanique automobile"]),
    "beauty.estheticien": ("Esthéticien", ["esthéticienne"]),
    "btp.chef_projet_genie_civil": ("Chef de projet génie civil", ["chargé de projet génie civil"]),
    "btp.dessinateur_architectural": ("Dessinateur en bâtiment", ["dessin de bâtiment", "dessinateur architectural"]),
    "btp.dessinateur_projeteur": ("Dessinateur projeteur", ["technicien dessinateur en bâtiment"]),
    "btp.ingenieur_genie_civil": ("Ingénieur génie civil", ["ingénieur en génie civil"]),
    "btp.ingenieur_hydraulique": ("Ingénieur hydraulique", []),
    "btp.technicien_architecture_urbanisme": ("Technicien en architecture et urbanisme", []),
    "btp.technicien_batiment": ("Technicien en bâtiment", ["technicien bâtiment"]),
    "btp.technicien_genie_civil": ("Technicien en génie civil", []),
    "edu.formateur_professionnel": ("Formateur", ["formatrice", "formateur en génie civil", "formateur en réseaux informatiques", "formateur professionnel"]),
    "edu.prof_universitaire": ("Professeur universitaire", ["maître de conférences", "أستاذ محاضر"]),
    "finance.comptable": ("Comptable", ["comptabilité", "technicien comptable"]),
    "finance.controleur_gestion": ("Contrôleur de gestion", ["contrôle de gestion"]),
    "health.infirmier": ("Infirmier", ["soins infirmiers", "infirmière"]),
    "health.medecin_generaliste": ("Médecin généraliste", []),
    "industry.maintenance_industrielle": ("Technicien de maintenance", ["maintenance industrielle"]),
    "industry.qualite": ("Responsable qualité", ["responsable qualité hse", "responsable hse"]),
    "industry.responsable_hse": ("Responsable HSE", ["responsable hygiène sécurité environnement"]),
    "industry.technicien_electrique": ("Technicien électrique", ["هندسة كهربائية"]),
    "industry.technicien_electromecanique": ("Technicien électromécanique", []),
    "it.administrateur_reseaux": ("Administrateur réseaux", ["réseaux informatiques"]),
    "it.administrateur_systemes": ("Administrateur systèmes", ["administrateur de bases de données"]),
    "it.base_donnees": ("Administrateur de bases de données", ["DBA"]),
    "it.cybersecurite": ("Responsable sécurité des systèmes d'information", ["RSSI"]),
    "it.data_analyst": ("Data analyst", ["data performance analyst"]),
    "it.data_scientist": ("Data scientist", ["data science", "data analyst"]),
    "it.developpeur_logiciel": ("Développeur informatique", ["développement informatique", "développeur logiciel"]),
    "it.responsable_si": ("Responsable des systèmes d'information", ["systèmes d'information"]),
    "it.technicien_developpement_informatique": ("Technicien en développement informatique", ["développement informatique"]),
    "it.technicien_informatique": ("Technicien informatique", []),
    "it.technicien_reseaux": ("Technicien réseaux", []),
    "it.technicien_support": ("Technicien support informatique", []),
    "it.technicien_systemes_information": ("Technicien systèmes d'information", []),
    "it.telecom": ("Ingénieur télécommunications", ["télécommunications"]),
    "management.charge_projet": ("Chargé de projet", ["chef de projet"]),
    "operations.technicien_gestion_maintenance": ("Technicien en gestion et maintenance", []),
    "sales.charge_contenu": ("Chargé de contenu", ["rédacteur de contenu"]),
    "sales.commercial": ("Commercial", ["technico commercial"]),
    "sales.communication": ("Chargé de communication", ["communication", "service communication", "chargé de projet communication"]),
    "sales.marketing": ("Chargé de marketing", ["chargé de publicité"]),
    "sales.publicite": ("Chargé de publicité", ["chargée de publicité"]),
    "sales.responsable_communication": ("Responsable communication", ["chef de service communication"]),
}
DIPLOMAS = {"finance.comptable": ["Licence en comptabilité"], "finance.controleur_gestion": ["Licence en comptabilité"], "health.infirmier": ["Diplôme d'infirmier"]}
OFFICIAL = [("2651", "Dessinateurs humoristiques et caricaturistes"), ("9999", "Artisans n.c.a"), ("7115", "Charpentiers en bois")]


def market_json() -> dict:
    rows = [{"id": i, "label": label, "sector": i.split(".")[0], "family": "f", "aliases": aliases, "diplomas": DIPLOMAS.get(i, [])} for i, (label, aliases) in MARKET.items()]
    return {"professions": rows}


def official_json() -> dict:
    return {"records": [{"code": c, "label": label, "grand_group_label": "Groupe", "major_group_label": ""} for c, label in OFFICIAL]}
