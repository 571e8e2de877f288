"""Thresholds, role sets and the role schema."""

from __future__ import annotations

# Geometry and typography thresholds, in points.
MIN_WIDTH, MIN_HEIGHT = 144, 72
RECT_TOLERANCE = 0.5
AREA_RATIO = (0.5, 2.0)
BASELINE_DROP, SIZE_CHANGE, FONT_EPS = 1.0, 0.1, 0.01
BULLET_Y, BULLET_X, BULLET_MAX_HEIGHT = 3, 3, 30
BULLET_WIDTH, BULLET_HEIGHT, BULLET_SLACK = 3.75, 5.0, 1.0
EDGE_TOLERANCE, INDENT = 2, 10
LINK_MIN_SCORE = 0.3
HEADING_ABOVE_BODY, HEADING_LEVELS = 0.5, 6
ARTIFICIAL_SPACING = 0.30
EXCERPT = 30

# Role sets.
GROUPING = ("Part", "Sect", "Art", "Div")
HEADINGS = ("P", "H1", "H2", "H3", "H4", "H5", "H6")
ARTIFACT_ROLES = ("P", "Link", "Span", "Figure", "Lbl", "LBody")
# Roles among whose children lists are sought, and roles that are no members of one.
LIST_PARENTS = ("Art", "Part", "Sect", "Div", "Document")
NO_LIST_MEMBERS = ("Art", "Part", "Sect", "Div", "Document", "L", "LI", "Lbl", "LBody", "Table", "TR", "TD", "TH", "THead", "TBody", "TFoot")
TOC_CHILDREN = ("Caption", "TOC", "TOCI")

# Children that each role allows.
ALLOWED = {
    "Annot": "Span",
    "Art": "BlockQuote Caption Div Figure H1 H2 H3 H4 H5 H6 L Note P Sect Table TOC",
    "BibEntry": "Span",
    "BlockQuote": "L Link P Reference Span",
    "Caption": "Lbl Span P",
    "Code": "",
    "Div": "BlockQuote Caption Div Figure H1 H2 H3 H4 H5 H6 L Link Note P Sect Table TOC",
    "Document": "Art BlockQuote Caption Div Figure H1 H2 H3 H4 H5 H6 Index L Note P Part Sect Table TOC",
    "Figure": "Caption Lbl",
    "Form": "",
    "Formula": "Caption Lbl",
    "H1": "Lbl Span Note Reference",
    "H2": "Lbl Span Note Reference",
    "H3": "Lbl Span Note Reference",
    "H4": "Lbl Span Note Reference",
    "H5": "Lbl Span Note Reference",
    "H6": "Lbl Span Note Reference",
    "Index": "L P",
    "L": "Caption LI",
    "Lbl": "Span Figure",
    "LBody": "Code Figure Formula L Link Note Quote P Reference Span",
    "LI": "Lbl LBody",
    "Link": "Figure Lbl P Span",
    "Note": "L Lbl P Figure Caption",
    "P": "Annot BibEntry Code Figure Form Formula Link Note Quote Reference Span",
    "Part": "Art BlockQuote Caption Div Figure H1 H2 H3 H4 H5 H6 L Link Note P Sect Table TOC",
    "Quote": "Span",
    "Reference": "Lbl Link Span",
    "Sect": "Art BlockQuote Caption Div Figure H1 H2 H3 H4 H5 H6 L Note P Sect Table",
    "Span": "Link Reference Span",
    "Table": "Caption TR THead TBody TFoot",
    "TBody": "TR",
    "TD": "P Span",
    "TFoot": "TR",
    "TH": "P Span",
    "THead": "TR",
    "TOC": "Caption TOC TOCI",
    "TOCI": "Lbl P Span",
    "TR": "TH TD",
}
REQUIRED = {"L": ["LI"]}
PATTERNS = {"LI": "Lbl? LBody"}

# Artifact patterns, searched without regard to case.
ARTIFACTS = {
    "footer-url-timestamp": r"https?://[^\s]+.*\[\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\s*[AP]M\]",
    "timestamp-only": r"^\s*\[\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\s*[AP]M\]\s*$",
    "page-number": r"^\s*Page\s+\d+\s*(of\s+\d+)?\s*$",
}

# Ligature code points and what they stand for.
LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}

# Codes of fonts named Arial and what they stand for, where they are mapped to its first letter.
ARIAL_CODES = {0x00BF: "fi", 0x1087: "ff", 0x108B: "st"}

# Notes in titles.
NOTE_PREFIX, TOOL_MARK, NOTE_SEPARATOR, VERIFIED = "__", ":", " // ", "OK"

# Kinds of issues and what a group of them is called.
LABELS = {
    "IMAGE_ONLY_DOCUMENT": "image-only document with no text",
    "FALSE_PDFUA_CONFORMANCE": "false PDF/UA conformance claim",
    "LANGUAGE_NOT_SET": "language not set",
    "NOT_TAGGED_PDF": "PDF not marked as tagged",
    "NO_STRUCT_TREE": "structure tree missing",
    "TAB_ORDER_NOT_SET": "tab order not set",
    "LIGATURE_MAPPING_BROKEN": "fonts with broken ligature mappings",
    "TAG_UNKNOWN_ROLE": "tags with unknown roles",
    "TAG_WRONG_PARENT": "tags with wrong parent",
    "TAG_WRONG_CHILD": "tags with wrong children",
    "TAG_WRONG_CHILD_COUNT": "tags with wrong child count",
    "TAG_WRONG_CHILD_PATTERN": "tags with wrong child pattern",
    "FIGURE_WITH_TEXT": "Figure elements containing text",
    "FIGURE_MISSING_ALT": "images missing alt text",
    "EMPTY_LINK_TAG": "Link elements without description",
    "INVALID_LINK_URI": "Link elements with invalid URIs",
    "LINK_SPLIT_ACROSS_TAGS": "single links split across several Link tags",
    "MISSING_DOCUMENT_ELEMENT": "no Document element under /StructTreeRoot",
    "PAGE_PARTS_NOT_NORMALIZED": "elements not grouped into page-level Part elements",
    "STRUCT_TREE_OUT_OF_ORDER": "structure tree siblings out of reading order",
    "NEEDLESS_NESTING": "unnecessary Part/Sect/Art/Div grouping elements",
    "MISTAGGED_ARTIFACT": "tagged content that should be artifacts",
    "MISARTIFACTED_TEXT": "artifact blocks containing text that should be tagged",
    "UNMARKED_LINK": "Link annotations not tagged",
    "UNEXPECTED_WIDGET": "non-functional Widget annotations",
    "ORPHANED_CONTENT": "orphaned MCRs",
    "INCONSISTENT_PARENT_TREE": "marked content missing from the page ParentTree",
    "EMPTY_ELEMENT": "empty structure elements",
    "LIST_TAGGED_AS_PARAGRAPHS": "list tagged as a series of paragraphs",
    "SUBLIST_TAGGED_AS_PARAGRAPHS": "sublist tagged as a series of paragraphs",
    "LIST_SPLIT_BY_SUBLIST": "list split in two around a sublist",
    "BULLET_ALIGNED_KIDS_IN_ELEMENT": "bullet-aligned content inside non-list element",
    "PARAGRAPH_OF_LINKS": "paragraphs containing only links",
    "ROLEMAP_PRESENT": "RoleMap present in structure tree root",
    "SCRIBBLED_INSTRUCTION": "elements with structural-instruction scribbles",
    "STALE_SCRIBBLE": "elements with stale workflow scribbles in /T",
    "NAMED_DESTINATIONS_PRESENT": "named destinations in /Catalog /Names /Dests",
    "WEB_CAPTURES_NOT_GROUPED": "Web Capture URLs not wrapped in Article elements",
    "WEB_CAPTURES_BADLY_ORDERED": "Web Capture pages not in configured URL order",
    "MISTAGGED_HEADING": "headings tagged as paragraphs",
    "IMPROPERLY_NESTED_HEADING": "headings with skipped or out-of-order levels",
    "IRREGULAR_TOC": "TOC contents not nested into a TOCI hierarchy",
    "MIXED_FONT_MARKED_CONTENT": "marked content lumping differently-sized lines",
}
