"""Document types, hierarchy, routing, plans and texts that must equal the known ones."""

# Document types.
DOC_TYPES = ["LGUC", "OGUC", "DDU", "DDU_ESPECIFICA", "LEY", "DFL", "DL", "DS", "CGR"]

# Key prefix of each document type, tested in this order.
KEY_PREFIXES = [("DDU-ESP-", "DDU_ESPECIFICA"), ("DDU-", "DDU"), ("LEY-", "LEY"), ("DFL-", "DFL"),
                ("DL-", "DL"), ("DS-", "DS"), ("CGR-", "CGR")]
KEY_WHOLE = ["LGUC", "OGUC"]
KEY_FALLBACK = "DDU"

# Free-text markers of a document type, tested in this order.
TYPE_MARKERS = [("DFL", ["DFL", "DECRETO CON FUERZA"]), ("DL", ["DL", "DECRETO LEY"]),
                ("DS", ["DS", "DECRETO SUPREMO"])]
TYPE_MARKER_FALLBACK = "LEY"
DEFAULT_SOURCE_URL = "https://www.bcn.cl/leychile/"

# Types a reference may name.
REF_TYPES = ["LGUC", "OGUC", "DDU", "DS", "DFL", "DL", "LEY"]
TYPES_WITHOUT_NUMBER = ["LGUC", "OGUC"]

# Hierarchy, strongest first; unknown counts as the last.
HIERARCHY = ["ley", "reglamento", "instruccion", "resolucion", "norma_tecnica", "otro"]

# Types of the first retrieval layer.
HIGH_TYPES = ["LGUC", "OGUC", "Ley", "DFL", "DL"]

# Domain to document types, in order of priority.
ROUTING = {
    "urbanismo": ["LGUC", "OGUC", "DDU", "DDU_ESPECIFICA", "DS", "DFL"],
    "construccion": ["OGUC", "DDU", "DDU_ESPECIFICA", "LGUC", "DS"],
    "accesibilidad": ["DS", "Ley", "OGUC", "DDU"],
    "copropiedad": ["Ley", "DS", "OGUC"],
    "medioambiente": ["Ley", "DS", "DFL", "DL"],
    "patrimonio": ["Ley", "DS", "DDU"],
    "salud": ["DS", "Ley", "DFL"],
    "aguas": ["DFL", "DL", "DS"],
    "vialidad": ["DFL", "DS", "Ley"],
    "electricidad": ["DFL", "DS", "Ley"],
    "defensa": ["DFL", "DS", "DL"],
    "bienes_nacionales": ["DL", "Ley", "DS"],
}
DEFAULT_DOMAIN = "construccion"

# Monthly limits of each plan (null means unlimited).
PLAN_LIMITS = {"free": 20, "beta": 50, "pro": 300, "admin": None}
FLAT_LIMIT = 50
SUBSCRIPTION_LIMITS = {"free": 50, "pro": 500}
UNLIMITED = 999999

# Shortest text each type may have.
MIN_CHARS = {"LGUC": 50_000, "OGUC": 100_000, "DDU": 500}
MIN_CHARS_DEFAULT = 500

# Navigation words at the head of scraped texts.
NAV_WORDS = ["Ocultar notas", "Texto", "Versiones", "Jurisprudencia", "Escuchar", "Proyectos de Ley",
             "Historia de la Ley", "Inicio", "Búsqueda", "Autores"]
NAV_MAX_LINES = 25

# Page furniture of the source texts.
CODE_PAGE_HEADER = (r"(?m)^Decreto \d+, VIVIENDA \(\d+\)\s*\nBiblioteca del Congreso Nacional.*?"
                    r"\npágina \d+ de \d+\s*$")
LAW_PAGE_HEADER = r"(?m)^(?:Ley Chile|Biblioteca del Congreso Nacional).*$"
RULING_PAGE_HEADER = (r"(?m)^(?:Contraloría General de la República|www\.contraloria\.cl"
                      r"|República de Chile).*$")
RULING_SIGNATURE = (r"(?i)(?:RAMIRO MENDOZA|JORGE BERMÚDEZ|DORVAL KÜHNE|OSVALDO ITURRIAGA"
                    r"|Contralor General)")

# File choice.
FILE_IGNORE = ["orig", "Modificacion", "Reemplaza", "modifica"]
FILE_SOURCES = ["BCN", "FAOLEX", "MMA", "MOP", "MINSAL", "DO"]

# Texts added to an answer.
DISCLAIMER_TEXT = (
    "\n\n---\n⚠️ **Aviso legal**: Esta respuesta es orientativa y no constituye asesoría jurídica profesional. "
    "Verifica siempre el texto vigente en BCN (www.bcn.cl) y consulta con un profesional habilitado."
)
CHECK_NOTE = ("\n\n> 🔍 **Nota de verificación automática**: {n} artículo(s) citado(s) no pudieron "
              "verificarse en el corpus local. Confirma en BCN: www.bcn.cl")
CONTRADICTION_NOTE = (
    "\n\n> ⚠️ **Verificación automática de coherencia**: Esta respuesta contiene lenguaje afirmativo,\n"
    "> pero el corpus recuperado incluye disposiciones restrictivas: {norms}.\n"
    "> Antes de actuar sobre esta conclusión, confirma directamente con la DOM o autoridad competente."
)
EMPTY_CONTEXT = "No se encontraron artículos relevantes en la base de conocimiento."
RELATIONS_HEADER = "\nRELACIONES NORMATIVAS DETECTADAS EN EL GRAFO:\n"
NO_HISTORY = "SIN HISTORIAL"
TOO_SHORT = "Respuesta demasiado corta"
NO_DISCLAIMER = "Falta disclaimer legal"
UNVERIFIED = "Art. {art} citado en la respuesta no está en el contexto recuperado — verificar en BCN"
