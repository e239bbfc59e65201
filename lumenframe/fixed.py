"""Labels, spellings and limits that results must agree on."""

# Budget buckets, from the limit of one to that of the next, in euros.
BUDGETS = [("Moins de 2 M€", 0), ("2 à 5 M€", 2_000_000), ("5 à 10 M€", 5_000_000), ("10 à 20 M€", 10_000_000), ("Plus de 20 M€", 20_000_000)]

# The bucket of each genre.
GENRES = {
    "animation": "Animation", "action": "Aventure/Policier/Thriller", "arts martiaux": "Aventure/Policier/Thriller",
    "aventure": "Aventure/Policier/Thriller", "espionnage": "Aventure/Policier/Thriller", "judiciaire": "Aventure/Policier/Thriller",
    "policier": "Aventure/Policier/Thriller", "thriller": "Aventure/Policier/Thriller", "western": "Aventure/Policier/Thriller",
    "biopic": "Biopic/Guerre/Histoire", "guerre": "Biopic/Guerre/Histoire", "historique": "Biopic/Guerre/Histoire",
    "péplum": "Biopic/Guerre/Histoire", "comédie": "Comédie/Comédie dramatique", "comédie dramatique": "Comédie/Comédie dramatique",
    "comédie musicale": "Comédie/Comédie dramatique", "famille": "Comédie/Comédie dramatique", "musical": "Comédie/Comédie dramatique",
    "romance": "Comédie/Comédie dramatique", "documentaire": "Documentaire", "drame": "Drame", "opéra": "Drame",
    "épouvante-horreur": "Fantastique/Horreur/SF", "expérimental": "Fantastique/Horreur/SF", "fantastique": "Fantastique/Horreur/SF",
    "science fiction": "Fantastique/Horreur/SF",
}

# Free-to-air broadcasters by spelling.
FREE_BROADCASTERS = {
    "tf1": "TF1", "france2": "France2", "2": "France2", "f2": "France2", "fr2": "France2", "france3": "France3", "3": "France3", "f3": "France3",
    "fr3": "France3", "france4": "France4", "4": "France4", "f4": "France4", "france5": "France5", "5": "France5", "f5": "France5",
    "francetv": "FranceTV", "france": "FranceTV", "frtv": "FranceTV", "fr": "FranceTV", "franceô": "FranceÔ", "fô": "FranceÔ", "ô": "FranceÔ",
    "o": "FranceÔ", "arte": "Arte", "m6": "M6", "gulli": "Gulli", "6ter": "6Ter", "c8": "C8", "c9": "C9", "d8": "Direct8", "direct": "Direct8",
    "w9": "W9", "cstar": "CSTAR", "hd1": "HD1", "tmc": "TMC", "tfx": "TFX", "nt1": "NT1", "nrj12": "NRJ12", "rmc": "RMC", "tv5": "TV5",
    "story": "STORY",
}

# Paying broadcasters by spelling. "C+" can't be met, as lookups are in lower case.
PAYING_BROADCASTERS = {
    "canal": "Canal+", "canal+": "Canal+", "c+": "Canal+", "C+": "Canal+", "cine+": "Ciné+", "ciné+": "Ciné+", "cinécinéma": "Ciné+",
    "disney": "Disney+", "disney+": "Disney+", "netflix": "Netflix", "netlfix": "Netflix", "amazon": "AmazonPrime", "ocs": "OCS", "13eme": "13èmeRue",
    "13ème": "13èmeRue", "orange": "OrangeTV", "tv5": "TV5", "tps": "TPS", "altice": "Altice", "j": "CanalJ", "max": "Max",
}

# Countries by spelling. The last can't be met, as lookups are in lower case.
COUNTRIES = {
    "nc": "NC", "": "NC", "afrique du sud": "Afrique du sud", "af du sud": "Afrique du sud", "af. du sud": "Afrique du sud", "algérie": "Algérie",
    "algerie": "Algérie", "allemagne": "Allemagne", "all": "Allemagne", "argentine": "Argentine", "arg": "Argentine", "arménie": "Arménie",
    "armenie": "Arménie", "belgique": "Belgique", "belg": "Belgique", "bel": "Belgique", "be": "Belgique", "bosnie-herzégovine": "Bosnie-Herzégovine",
    "bosnie herz": "Bosnie-Herzégovine", "bosnie": "Bosnie-Herzégovine", "bosnie herzegovine": "Bosnie-Herzégovine",
    "bosnie herzégovine": "Bosnie-Herzégovine", "brésil": "Brésil", "bresil": "Brésil", "bulgarie": "Bulgarie", "bulg": "Bulgarie",
    "canada": "Canada", "can": "Canada", "corée": "Corée", "coree": "Corée", "danemark": "Danemark", "dan": "Danemark", "espagne": "Espagne",
    "es": "Espagne", "esp": "Espagne", "etats unis": "États-Unis", "us": "États-Unis", "finlande": "Finlande", "fin": "Finlande", "france": "France",
    "fr": "France", "grande-bretagne": "Grande-Bretagne", "gb": "Grande-Bretagne", "grande bretagne": "Grande-Bretagne", "r-u": "Grande-Bretagne",
    "grèce": "Grèce", "grece": "Grèce", "géorgie": "Géorgie", "georgie": "Géorgie", "irlande": "Irlande", "irl": "Irlande", "israël": "Israël",
    "israel": "Israël", "isr": "Israël", "italie": "Italie", "it": "Italie", "luxembourg": "Luxembourg", "lux": "Luxembourg",
    "macédoine": "Macédoine", "macédoine du n": "Macédoine", "macedoine": "Macédoine", "mexique": "Mexique", "mex": "Mexique", "norvège": "Norvège",
    "norvege": "Norvège", "norv": "Norvège", "nouvelle-zélande": "Nouvelle-Zélande", "nouvelle zelande": "Nouvelle-Zélande", "pays-bas": "Pays-Bas",
    "pays bas": "Pays-Bas", "pologne": "Pologne", "pol": "Pologne", "portugal": "Portugal", "port": "Portugal", "roumanie": "Roumanie",
    "roum": "Roumanie", "république tchèque": "République tchèque", "rép. tch.": "République tchèque", "rép tchèque": "République tchèque",
    "rép tch": "République tchèque", "republique tcheque": "République tchèque", "rep tchèque": "République tchèque",
    "rep tcheque": "République tchèque", "rep tcheq": "République tchèque", "slovénie": "Slovénie", "slovenie": "Slovénie", "suède": "Suède",
    "suede": "Suède", "sénégal": "Sénégal", "senegal": "Sénégal", "taïwan": "Taïwan", "taiwan": "Taïwan", "turquie": "Turquie", "turquiee": "Turquie",
    "Côte d'Ivoire": "Côte d'Ivoire",
}

# Labels of the face classifier's outputs, in order: 7 ethnicities, 2 genders, 9 ages.
ETHNICITIES = ["White", "Black", "Latino_Hispanic", "East Asian", "Southeast Asian", "Indian", "Middle Eastern"]
GENDERS = ["Male", "Female"]
AGES = ["0-2", "3-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70+"]

# Columns of the yearly approval sheets and what they are called here.
SHEET_COLUMNS = {
    "TITRE": "original_name", "VISA": "visa_number", "REALISATEUR": "directors_names", "PRODUCTEURS": "producers_names", "DEVIS": "budget", "year": "cnc_agrement_year",
    "GENRE": "cnc_genres", "EOF": "eof", "RANG": "cnc_rank", "BONUS PARITE ": "parity_bonus", "ASR": "asr", "PAYANTE": "paying_broadcasters", "CLAIR": "free_broadcasters",
    "SOFICA": "sofica_funding", "CREDIT D'IMPOT": "tax_credit", "AIDE REGIONALE": "regional_funding", "NATIONALITE": "film_country_budget_allocation_rates",
}
