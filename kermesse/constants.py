"""Fixed values of the data contract: column lists, code tables, labels, patterns."""

# --- Fixed values: these must stay exactly as they are for results to match. ---

RAW_COLUMNS = (
    "uid", "title", "description", "longDescription", "keywords", "dateRange",
    "createdAt", "updatedAt", "timings", "firstTiming", "lastTiming", "nextTiming",
    "image", "attendanceMode", "status", "registration", "location", "age",
    "accessibility", "conditions", "billetterie", "links", "agenda_uid", "agenda_title",
)

CLEAN_COLUMNS = (
    "uid", "title", "description", "longDescription", "keywords", "dateRange",
    "createdAt", "updatedAt", "timings", "firstTiming", "lastTiming", "nextTiming",
    "image", "mode_participation", "status", "registration", "age",
    "accessibility_text", "conditions", "billetterie", "links", "agenda_uids",
    "agenda_titles", "location_name", "location_address", "location_city",
    "location_postal_code", "location_department", "location_region",
    "location_latitude", "location_longitude", "location_text",
)

CHUNK_COLUMNS = (
    "uid", "title", "chunk_id", "chunk_index", "chunk_text", "description",
    "longDescription", "keywords", "dateRange", "timings", "firstTiming",
    "lastTiming", "nextTiming", "image", "mode_participation", "status",
    "registration", "age", "accessibility_text", "conditions", "billetterie",
    "links", "agenda_uids", "agenda_titles", "location_name", "location_address",
    "location_postal_code", "location_latitude", "location_longitude",
)

NEVER_CONSTANT_COLUMNS = ("uid", "title", "description", "longDescription", "keywords")

ACCESSIBILITY_LABELS = {
    "hi": "handicap auditif",
    "vi": "handicap visuel",
    "pi": "handicap psychique",
    "mi": "handicap moteur",
    "ii": "handicap intellectuel",
}
NO_ACCESSIBILITY = "Aucune information d'accessibilité"

ATTENDANCE_LABELS = {1: "Présentiel", 2: "En ligne", 3: "Hybride"}

STATUS_LABELS = {
    1: "Programmé",
    2: "Reprogrammé",
    3: "Déplacé en ligne",
    4: "Reporté",
    5: "Complet",
    6: "Annulé",
}

REGISTRATION_LABELS = {"email": "Email", "phone": "Téléphone", "link": "Lien"}
REGISTRATION_DEFAULT = "Contact"

REGION_ALIASES = {"occitanie": "Occitanie", "occitania": "Occitanie"}
DEPARTMENT_ALIASES = {"haute-garonne": "Haute-Garonne", "alto garona": "Haute-Garonne"}

# Label -> location field.
LOCATION_LABELS = (
    ("Lieu", "name"),
    ("Adresse", "address"),
    ("Description du lieu", "description"),
    ("Accès", "access"),
    ("Téléphone", "phone"),
    ("Email", "email"),
    ("Site web", "website"),
    ("Image du lieu", "image"),
)

# Output column suffix -> location field.
LOCATION_FIELDS = (
    ("name", "name"),
    ("address", "address"),
    ("city", "city"),
    ("postal_code", "postalCode"),
    ("department", "department"),
    ("region", "region"),
    ("latitude", "latitude"),
    ("longitude", "longitude"),
)

# Label -> field of a link's `data` object.
LINK_LABELS = (
    ("Titre", "title"),
    ("Auteur", "author"),
    ("Source", "provider_name"),
    ("Description", "description"),
)
LINK_URL_LABEL = "Lien"
LINK_THUMBNAIL_LABEL = ("Miniature", "thumbnail_url")

# Label -> clean event column, in the text that gets embedded.
DOCUMENT_LABELS = (
    ("Titre", "title"),
    ("Description", "description"),
    ("Description détaillée", "longDescription"),
    ("Mots-clés", "keywords"),
    ("Date", "dateRange"),
    ("Horaires", "timings"),
    ("Lieu", "location_name"),
    ("Adresse", "location_address"),
    ("Public", "age"),
    ("Accessibilité", "accessibility_text"),
    ("Conditions", "conditions"),
    ("Mode de participation", "mode_participation"),
    ("Statut", "status"),
)

# Label -> result column, in the context handed to the generator.
CONTEXT_LABELS = (
    ("Titre", "title"),
    ("Description", "description"),
    ("Description détaillée", "longDescription"),
    ("Mots-clés", "keywords"),
    ("Date", "dateRange"),
    ("Horaires", "timings"),
    ("Premier horaire", "firstTiming"),
    ("Dernier horaire", "lastTiming"),
    ("Prochain horaire", "nextTiming"),
    ("Lieu", "location_name"),
    ("Adresse", "location_address"),
    ("Ville", "location_city"),
    ("Code postal", "location_postal_code"),
    ("Public / âge", "age"),
    ("Accessibilité", "accessibility_text"),
    ("Conditions", "conditions"),
    ("Mode de participation", "mode_participation"),
    ("Inscription", "registration"),
    ("Billetterie", "billetterie"),
    ("Lien", "links"),
    ("Statut", "status"),
)
CONTEXT_SEPARATOR = "\n\n---\n\n"

MISSING_WORDS = ("", "missing value")
DEFAULT_AGENDA_TITLE = "Sans titre"
# "2024-12-31 20:30:00" is shown as "31/12/2024 à 20h30".
DATETIME_PATTERN = r"^\+?(\d+)-(\d\d)-(\d\d) (\d\d):(\d\d).*$"
DATETIME_SHOWN = "$3/$2/$1 à $4h$5"
TAG_PATTERN = "<[^>]+>"
RULE_PATTERN = "[-_]{3,}"

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
EMBED_BATCH = 32
DEFAULT_K = 5
MIN_K = 1
MAX_K = 10
OVERFETCH = 3
SPARSE_SHARE = 0.95
RECENT_MONTHS = 12
LANGUAGE = "fr"

# --- End of fixed values. ---

# Every character Unicode calls white space, plus the four ASCII separators
# U+001C..U+001F: what a Unicode-aware strip removes. Spark's own trim() removes only U+0020.
WHITESPACE = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ),
    )
)
WHITESPACE_RUN = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)

SYSTEM_PROMPT = (
    "Tu conseilles des sorties et des événements culturels. Appuie-toi seulement sur les "
    "événements donnés, sans rien inventer (ni date, ni lieu, ni prix). Justifie chaque "
    "proposition en une phrase, et dis-le simplement si aucun événement ne convient. "
    "Écris en français."
)
HUMAN_PROMPT = "Demande : {question}\n\nÉvénements :\n\n{context}"
