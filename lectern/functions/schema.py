"""Item schema: generic fields, the field of a type that holds each, labels and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Item type -> generic field -> the field of that type that holds it; all other fields go by their generic name.
TYPE_FIELDS = {
    "artwork": {"medium": "artworkMedium"},
    "audioRecording": {"medium": "audioRecordingFormat", "publisher": "label"},
    "bill": {"number": "billNumber", "pages": "codePages", "volume": "codeVolume", "authority": "legislativeBody"},
    "blogPost": {"publicationTitle": "blogTitle", "type": "websiteType"},
    "book": {"medium": "format"},
    "bookSection": {"publicationTitle": "bookTitle", "medium": "format"},
    "case": {"title": "caseName", "authority": "court", "date": "dateDecided", "number": "docketNumber", "pages": "firstPage", "volume": "reporterVolume"},
    "computerProgram": {"publisher": "company"},
    "conferencePaper": {"publicationTitle": "proceedingsTitle"},
    "dataset": {"medium": "format", "number": "identifier", "publisher": "repository", "place": "repositoryLocation"},
    "dictionaryEntry": {"publicationTitle": "dictionaryTitle"},
    "email": {"title": "subject"},
    "encyclopediaArticle": {"publicationTitle": "encyclopediaTitle"},
    "film": {"publisher": "distributor", "type": "genre", "medium": "videoRecordingFormat"},
    "forumPost": {"publicationTitle": "forumTitle", "type": "postType"},
    "hearing": {"number": "documentNumber", "authority": "legislativeBody"},
    "interview": {"medium": "interviewMedium"},
    "letter": {"type": "letterType"},
    "manuscript": {"publisher": "institution", "type": "manuscriptType"},
    "map": {"type": "mapType"},
    "patent": {"date": "issueDate", "authority": "issuingAuthority", "status": "legalStatus", "number": "patentNumber", "originalDate": "priorityDate"},
    "podcast": {"medium": "audioFileType", "number": "episodeNumber"},
    "preprint": {"number": "archiveID", "type": "genre", "publisher": "repository"},
    "presentation": {"type": "presentationType", "publicationTitle": "sessionTitle"},
    "radioBroadcast": {"medium": "audioRecordingFormat", "number": "episodeNumber", "publisher": "network", "publicationTitle": "programTitle"},
    "report": {"publisher": "institution", "number": "reportNumber", "type": "reportType"},
    "standard": {"authority": "organization"},
    "statute": {"date": "dateEnacted", "title": "nameOfAct", "number": "publicLawNumber"},
    "thesis": {"type": "thesisType", "publisher": "university"},
    "tvBroadcast": {"number": "episodeNumber", "publisher": "network", "publicationTitle": "programTitle", "medium": "videoRecordingFormat"},
    "videoRecording": {"publisher": "studio", "medium": "videoRecordingFormat"},
    "webpage": {"publicationTitle": "websiteTitle", "type": "websiteType"},
}
# Item types that belong to another item.
CHILD_TYPES = ("attachment", "note", "annotation")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def typed_field(item_type: Column, field: Column) -> Column:
    """The field that holds a generic one in an item of this type; the name itself where the type has no own one."""
    pairs = {f"{t}|{g}": own for t, fields in TYPE_FIELDS.items() for g, own in fields.items()}
    return F.coalesce(_lookup(pairs, F.concat_ws("|", item_type, field)), field)


def generic_field(item_type: Column, field: Column) -> Column:
    """The generic name of a field of this type; the name itself where it is generic already."""
    pairs = {f"{t}|{own}": g for t, fields in TYPE_FIELDS.items() for g, own in fields.items()}
    return F.coalesce(_lookup(pairs, F.concat_ws("|", item_type, field)), field)


def label(name: Column) -> Column:
    """A camel-case name as words, each with a capital: ``bookSection`` -> ``Book Section``."""
    return F.regexp_replace(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)), "([a-z])([A-Z])", "$1 $2")


def display_title(item_type: Column, title: Column, filename: Column, note: Column) -> Column:
    """The title; for notes the first line of the note; else the file's name; else ``Untitled``."""
    from lectern.functions.text import first_line, html_to_text

    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = F.when(item_type == "note", first_line(html_to_text(note))).otherwise(blank(title))
    return F.coalesce(own, blank(filename), F.lit("Untitled"))
