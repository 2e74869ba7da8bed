"""Lookup tables, word lists and patterns that results depend on."""

from __future__ import annotations

# --- fixed values: site profile, language name in a URL -> code (19) ---------------------
SITE_NAME_TO_CODE = {
    "spanish": "es", "french": "fr", "german": "de", "italian": "it", "portuguese": "pt",
    "chinese": "zh", "japanese": "ja", "korean": "ko", "russian": "ru", "arabic": "ar",
    "hindi": "hi", "dutch": "nl", "swedish": "sv", "danish": "da", "finnish": "fi",
    "norwegian": "no", "polish": "pl", "turkish": "tr", "english": "en",
}

# --- fixed values: scored profile, code -> language name (24) ----------------------------
SCORED_CODE_TO_NAME = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese",
    "it": "Italian", "ja": "Japanese", "zh": "Chinese", "ar": "Arabic", "ko": "Korean",
    "nl": "Dutch", "sv": "Swedish", "da": "Danish", "fi": "Finnish", "no": "Norwegian",
    "pl": "Polish", "ru": "Russian", "tr": "Turkish", "vi": "Vietnamese", "th": "Thai",
    "id": "Indonesian", "hi": "Hindi", "he": "Hebrew", "cs": "Czech",
}

# --- fixed values: stop words of the text heuristic; on a tie the earlier language wins --
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "for", "with", "our", "is"],
    "es": ["el", "la", "de", "que", "y", "en", "para", "con", "nuestro", "una"],
    "fr": ["le", "la", "de", "et", "les", "des", "pour", "avec", "notre", "une"],
    "de": ["der", "die", "das", "und", "von", "mit", "für", "ist", "ein", "eine"],
    "pt": ["o", "a", "de", "e", "que", "em", "para", "com", "nosso", "uma"],
}
WORD_CHARS = "a-záéíóúüñçàèùâêîôûäöß"

# --- fixed values: HTTP status texts -----------------------------------------------------
STATUS_TEXT = {
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found",
    408: "Request Timeout", 418: "I'm a teapot", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable",
    504: "Gateway Timeout",
}

# --- fixed values: default sitemap locations, report messages ----------------------------
DEFAULT_SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml"]
CONFLICT_MESSAGE = (
    "Text heuristic conflicted with stronger page evidence and was not allowed to create a language."
)
SUPPRESSED_MESSAGE = (
    "Text heuristic suggested this language, but no trusted hreflang, html lang, URL path, "
    "or subdomain evidence was found."
)

SITE_CODES = sorted(SITE_NAME_TO_CODE.values())
SITE_NAMES = list(SITE_NAME_TO_CODE)
SITE_CODE_TO_NAME = {code: name.capitalize() for name, code in SITE_NAME_TO_CODE.items()}
SCORED_CODES = list(SCORED_CODE_TO_NAME)
