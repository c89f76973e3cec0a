"""Fixed values.

Word lists, patterns and field names that decide results. They have to hold
exactly these values for cleaned data, flags and texts to come out right, so
they are stated here once, as plain literals, and used from everywhere else.
"""

# Fields each cleaning rule looks at (compared with the lower-cased field name).
WHITESPACE_FIELDS = (
    "proveedor", "categoria", "estado_factura", "tipo",
    "nif_cif", "num_factura", "nombre", "descripcion",
)
WHITESPACE_SUFFIX = "_str"
CURRENCY_FIELDS = ("importe_base", "iva", "importe_total", "importe_pendiente")
DATE_FIELDS = ("fecha", "fecha_factura", "fecha_pago", "fecha_vencimiento")
TITLE_FIELDS = ("proveedor", "categoria", "estado_factura")

SPANISH_MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11,
    "diciembre": 12,
}

# Accepted spellings of the invoice type and of the invoice state.
TYPE_WORDS = {
    "Ingreso": ("ingreso", "ingrso", "ingeso", "ingreos", "ingresso", "ingresos", "income", "entrada"),
    "Gasto": ("gasto", "gatso", "gsato", "gasot", "gastoo", "gastos", "expense", "salida"),
}
STATUS_WORDS = {
    "Pagada": ("pagada", "pagda", "paga", "paid", "pagado"),
    "Pendiente": ("pendiente", "pendiete", "pendientte", "pending", "pdte"),
    "Vencida": ("vencida", "vencda", "vencido", "overdue"),
    "Parcialmente Pagada": (
        "parcialmente pagada", "parcial", "partial", "parcialmente", "parcialment pagada",
    ),
}

# Personal data and secrets, replaced in this order.
REDACTIONS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE]"),
    (r"\b\d{8}[A-Za-z]\b", "[NIF]"),
    (r"\b[A-Za-z]\d{8}\b", "[CIF]"),
    (r"sk-[a-zA-Z0-9]{32,}", "[API_KEY]"),
    (r"(?i)api[_-]?key[\"']?\s*[:=]\s*[\"']?[\w-]+", "[API_KEY]"),
    (r"(?i)password[\"']?\s*[:=]\s*[\"']?[\w-]+", "[PASSWORD]"),
)

# Phrases that try to overrule a prompt; case does not matter.
INJECTIONS = (
    r"ignore\s+(previous|above|all)\s+instructions?",
    r"disregard\s+(previous|above|all)",
    r"forget\s+(previous|above|all)",
    r"new\s+instructions?:",
    r"system\s*:",
    r"\[INST\]",
    r"<\|im_start\|>",
    r"<\|system\|>",
)

# Words that tell what kind of question is asked; the first kind that fits wins.
QUESTION_WORDS = {
    "comparison": (
        "compar", "vs", "versus", "diferencia", "más que", "menos que", "mayor", "menor",
        "qué categoría", "cuál tiene más", "cuál tiene menos",
    ),
    "statistics": (
        "total", "suma", "promedio", "media", "máximo", "mínimo", "cuánto", "cuántos",
        "estadística", "resumen",
    ),
    "filter": (
        "muestra", "lista", "filtra", "busca", "encuentra", "facturas de", "pendientes",
        "pagadas", "del proveedor",
    ),
}

# Phrases in an answer that ask the reader for more detail.
UNCLEAR_PHRASES = (
    "no tengo suficiente información",
    "no puedo determinar",
    "necesito más detalles",
    "podrías especificar",
    "no está claro",
    "ambiguo",
    "i don't have enough",
    "could you clarify",
    "not clear",
)

# Type inference on text columns.
INTEGER_PATTERN = r"^-?\d+$"
FLOAT_PATTERN = r"^-?\d+[.,]?\d*$|^-?\d*[.,]\d+$"
CURRENCY_PATTERN = r"^-?[\d.,]+\s*(€|EUR|USD|\$)?$"
DATE_PATTERNS = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{2}-\d{2}-\d{4}$",
    r"^\d{1,2}\s+de\s+\w+\s+de\s+\d{4}$",
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}",
)
BOOLEAN_WORDS = ("true", "false", "yes", "no", "si", "sí", "1", "0", "verdadero", "falso")

# Statistics, index and segment fields of the analytics layer.
MONEY_FIELDS = ("importe_base", "iva", "importe_total", "importe_pendiente")
INDEX_FIELDS = ("fecha", "categoria", "proveedor", "tipo", "estado_factura")
SEGMENT_FIELDS = ("tipo", "estado_factura", "categoria", "proveedor")
DEDUPE_FIELDS = ("proveedor", "categoria")

# Text that counts as a missing value when clean CSV is read back (opt-in).
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

STATUS_PENDING = "pending"
STATUS_VALID = "valid"
STATUS_INVALID = "invalid"
STATUS_CORRECTED = "llm_corrected"
STATUS_REVIEW = "manual_review"
