"""What is known of the sites pages come from, as data; pass other tables for other sites."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: domains with their labels, selectors per site, suppressed phrases ---

SOURCES: dict[str, str] = {
    "federalreserve.gov": "Board of Governors",
    "newyorkfed.org": "New York Fed",
    "kansascityfed.org": "Kansas City Fed",
    "clevelandfed.org": "Cleveland Fed",
    "dallasfed.org": "Dallas Fed",
    "bostonfed.org": "Boston Fed",
    "frbsf.org": "San Francisco Fed",
    "minneapolisfed.org": "Minneapolis Fed",
    "stlouisfed.org": "St. Louis Fed",
    "chicagofed.org": "Chicago Fed",
    "atlantafed.org": "Atlanta Fed",
    "philadelphiafed.org": "Philadelphia Fed",
    "richmondfed.org": "Richmond Fed",
}

CONTENT = [".col-xs-12.col-sm-8.col-md-8", ".eventlist", ".col-md-8", "main", "article"]
TITLE = ["h3.title", "h1.title", ".article__header h1", ".pageheader h1"]
SPEAKER = [".speaker", ".author", ".article__author", ".speakerName"]
DATE = [".article__time", "time", ".pubdate", ".datetime", ".speakerDate"]

#: domain: (content, title, speaker, date) selectors, in order of trial
SELECTORS: dict[str, tuple[list[str], list[str], list[str], list[str]]] = {
    "federalreserve.gov": (
        [".col-xs-12.col-sm-8.col-md-8", ".article", "main"], ["h3.title", "h1.title", ".pageheader h1"], [".speaker", ".speakerName"], [".speakerDate", ".article__time", "time"],
    ),
    "newyorkfed.org": (
        [".ts-article-text", ".rich-text", ".article-body", ".mod-content", "main"], [".ts-article-title", "h1", ".hero__title"],
        [".ts-contact-info + .ts-contact-info", ".speaker", ".article__author", ".content-author"], [".ts-contact-info", "time", ".article__date", ".content-date"],
    ),
    "kansascityfed.org": ([".wysiwyg", ".article-body", ".main-content", "main"], ["h1", ".page-title", ".article-title"], [".speaker", ".author", ".article-meta__author"], ["time", ".article-date", ".date"]),
    "clevelandfed.org": ([".article-body", ".rte", ".content-body", "main"], ["h1", ".article-title", ".page-title"], [".speaker", ".author", ".article-author"], ["time", ".article-date", ".date"]),
    "dallasfed.org": (
        [".dal-main-content", ".article-body", ".field-name-body", ".rich-text", "main"], [".dal-headline", "h1", ".page-title", ".article__title"],
        [".dal-author", ".speaker", ".field-name-field-author", ".author"], [".dal-content-date", "time", ".date-display-single", ".article-date"],
    ),
    "bostonfed.org": ([".rich-text", ".copy", ".article-body", "main"], ["h1", ".hero-title", ".page-title"], [".speaker", ".author", ".content-author"], ["time", ".date", ".content-date"]),
    "frbsf.org": ([".entry-content", ".wysiwyg", ".article-content", "main"], ["h1", ".entry-title", ".page-title"], [".speaker", ".author", ".post-author"], ["time", ".entry-date", ".published"]),
    "minneapolisfed.org": ([".article-body", ".story-body", ".wysiwyg", "main"], ["h1", ".article-title", ".page-title"], [".speaker", ".author", ".story-author"], ["time", ".article-date", ".story-date"]),
    "stlouisfed.org": ([".article-body", ".rich-text", ".body-copy", "main"], ["h1", ".article-title", ".page-title"], [".speaker", ".author", ".meta-author"], ["time", ".article-date", ".meta-date"]),
    "chicagofed.org": ([".article-body", ".component--rich-text", ".rich-text", "main"], ["h1", ".page-title", ".article-title"], [".speaker", ".author", ".article-author"], ["time", ".article-date", ".date"]),
    "atlantafed.org": ([".article-body", ".richText", ".rte", "main"], ["h1", ".page-title", ".hero-title"], [".speaker", ".author", ".article__author"], ["time", ".date", ".article__date"]),
    "philadelphiafed.org": ([".article-body", ".rich-text", ".body-content", "main"], ["h1", ".page-title", ".article-title"], [".speaker", ".author", ".article-author"], ["time", ".article-date", ".published-date"]),
    "richmondfed.org": ([".article-body", ".wysiwyg", ".content-body", "main"], ["h1", ".page-title", ".article-title"], [".speaker", ".author", ".article-author"], ["time", ".article-date", ".date"]),
}

#: document type: patterns of blocks that are left out
SUPPRESSED: dict[str, list[str]] = {
    "press_release": [
        r"information received since the federal open market committee met",
        r"the committee seeks to achieve maximum employment and inflation at the rate of 2 percent over the longer run",
        r"in support of these goals, the committee decided to",
        r"voting for the monetary policy action were",
        r"the committee will continue reducing its holdings of treasury securities",
    ],
    "statement": [
        r"the committee seeks to achieve maximum employment and inflation at the rate of 2 percent over the longer run",
        r"the committee would be prepared to adjust the stance of monetary policy as appropriate",
        r"in considering the extent of additional policy firming",
        r"in assessing the appropriate stance of monetary policy",
    ],
    "press_conference": [r"thank you\.? i'?m happy to take your questions", r"let me say a few words about"],
}
#: (source, document type) and (speaker, document type): further patterns
SUPPRESSED_BY_SOURCE: dict[tuple[str, str], list[str]] = {
    ("Board of Governors", "press_release"): [r"for media inquiries, call \d{3}-\d{3}-\d{4}"],
    ("New York Fed", "press_release"): [r"contact .*?press office"],
}
SUPPRESSED_BY_SPEAKER: dict[tuple[str, str], list[str]] = {
    ("Jerome H. Powell", "press_conference"): [r"thank you\.? i'?ll be glad to take your questions"],
}

#: phrases that tell a document's type, in order of precedence
TYPE_PHRASES: list[tuple[str, list[str]]] = [
    ("press_conference", ["press conference"]),
    ("press_release", ["press release"]),
    ("testimony", ["testimony"]),
    ("interview", ["interview"]),
    ("qa_transcript", ["question-and-answer", "questions and answers", "q&a"]),
    ("statement", ["statement"]),
    ("prepared_remarks", ["remarks"]),
    ("statement", ["minutes"]),
    ("speech", ["speech"]),
]
DOCUMENT_TYPES = ["speech", "prepared_remarks", "press_release", "press_conference", "qa_transcript", "interview", "testimony", "statement", "comment", "unknown"]
CONTENT_TYPES = ["html", "pdf", "markdown", "text", "unknown"]
SEGMENT_TYPES = ["body", "question", "answer", "header", "footer", "unknown"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ORGANISATION_LINES = ["federal reserve board", "board of governors of the federal reserve system"]
NOT_A_SPEAKER = ["federal reserve", "board of governors"]
END_MARKS = ["last update", "return to text", "back to top"]
SHARE_PREFIXES = ["share", "facebook", "post"]

# --- end of fixed values ---


@dataclass(frozen=True)
class Site:
    domain: str
    content: list[str]
    title: list[str]
    speaker: list[str]
    date: list[str]


def site_of(host: str | None) -> Site | None:
    """The first site whose domain ends the host name."""
    for domain, lists in SELECTORS.items():
        if host and host.endswith(domain):
            return Site(domain, *lists)
    return None
