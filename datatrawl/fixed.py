"""Fixed values. Results depend on them, so they are stated plainly and kept together."""

# A link whose lower-cased target ends with one of these is a data set.
DOWNLOAD_SUFFIXES = (
    ".zip", ".tar", ".tgz", ".gz", ".csv", ".json", ".geojson", ".kml", ".kmz", ".gml", ".tab",
    ".tif", ".tiff", ".jp2", ".adf", ".ecw", ".e00", ".hdr", ".nc", ".img", ".dem",
)

# Content types that make an ambiguous link a data set. Compared exactly.
DOWNLOAD_MIME_TYPES = (
    "application/zip", "application/x-zip-compressed", "application/x-rar-compressed",
    "application/x-7z-compressed", "application/x-tar", "application/x-gtar",
    "application/x-gzip", "application/x-compressed",
)

# File name endings that a crawl does not visit (regular expression parts).
MEDIA_ENDINGS = (
    "css", "js", "bmp", "gif", "jpe?g", "png", "tiff?", "mid", "mp2", "mp3", "mp4", "wav", "avi",
    "mov", "mpeg", "ram", "m4v", "pdf", "rm", "smil", "wmv", "swf", "wma", "zip", "rar", "gz",
)

# Schemes an absolute URL may have.
URL_SCHEMES = ("http", "https", "ftp", "file", "jar", "mailto")

DIRECTION_WORDS = ("north", "south", "east", "west")
COORDINATE_LIMIT = 180.0

ABSTRACT_MIN_LENGTH = 150
NO_ABSTRACT = "None found"
TITLE_CAP = 6
NO_TITLE = "none"

# Only the last of the publishing verbs takes effect; the whole list is what was meant.
PUBLISH_ROOTS = ("create",)
PUBLISH_ROOTS_INTENDED = (
    "publish", "distribute", "distribution", "produce", "provide", "create",
)

SEARCH_TERMS = ("#GIS #data", "#GeoSpatial #data")
SEARCH_COUNT = 10
SEARCH_LANGUAGE = "en"
SEARCH_RESULT_TYPE = "recent"

SOURCE_SOCIAL = "SOCIAL_MEDIA"
SOURCE_MANUAL = "MANUAL_ENTRY"

# Status of a stored URL.
FROM_EXTRACTOR = 0
REVIEWED_GOOD = 1
REVIEWED_BAD = 2
INACTIVE_UNREVIEWED = 3
INACTIVE_REVIEWED = 4

# Entities that are decoded in text and attributes; the ampersand goes last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)

# Words that say what kind of organization a name is; the legal forms only end one.
ORGANIZATION_KINDS = (
    "University", "Institute", "Agency", "Department", "Council", "Bureau", "Ministry", "Commission",
    "Society", "Association", "Foundation", "Laboratory",
)
LEGAL_FORMS = ("Inc", "Ltd", "Corporation", "Corp", "LLC", "GmbH")

# Last words that mark a run of capitalised words as an organization.
ORGANIZATION_SUFFIXES = ORGANIZATION_KINDS + LEGAL_FORMS

# Words whose full stop doesn't end a sentence.
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Rev", "Gen", "Sen", "St", "Mt", "No", "Nos", "Vol", "Fig", "Dept",
    "Univ", "approx", "ca", "cf", "vs", "al",
)

# Endings of inflected words and what stands in their place; of several the longest counts.
ROOT_RULES = {
    "s": "", "ss": "ss", "us": "us", "is": "is", "ies": "y", "sses": "ss", "shes": "sh", "ches": "ch", "xes": "x",
    "ed": "", "ied": "y", "eed": "eed", "ated": "ate", "uted": "ute", "ized": "ize", "ised": "ise", "ided": "ide",
    "uced": "uce", "osed": "ose", "iled": "ile", "ired": "ire", "ured": "ure", "ared": "are", "ved": "ve", "nged": "nge",
    "pped": "p", "tted": "t", "nned": "n", "gged": "g", "mmed": "m", "rred": "r", "dded": "d",
    "ing": "", "ying": "y", "thing": "thing", "ating": "ate", "uting": "ute", "izing": "ize", "ising": "ise",
    "iding": "ide", "ucing": "uce", "osing": "ose", "iling": "ile", "iring": "ire", "uring": "ure", "aring": "are",
    "ving": "ve", "nging": "nge", "pping": "p", "tting": "t", "nning": "n", "gging": "g", "mming": "m", "rring": "r",
    "dding": "d",
}
ROOT_LETTERS = 3  # of a root by the rules, at least; one is a vowel
