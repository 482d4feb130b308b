"""Log search and log summaries as DataFrame operators."""

from siftline.operators.context import context
from siftline.operators.parse import detect_format, detect_per_key, parse
from siftline.operators.render import output_record, write_matches
from siftline.operators.scan_report import run_scan
from siftline.operators.search import search, search_files
from siftline.operators.summary import summary, summary_report
from siftline.operators.templates import assign, mine, template_counts
from siftline.session import prepare
from siftline.sources.files import head, heads, read_lines
from siftline.sources.tables import lines_from_table
from siftline.streaming.follow import follow_lines, follow_search

__all__ = [
    "assign", "context", "detect_format", "detect_per_key", "follow_lines", "follow_search", "head", "heads",
    "lines_from_table", "mine", "output_record", "parse", "prepare", "read_lines", "run_scan", "search",
    "search_files", "summary", "summary_report", "template_counts", "write_matches",
]
