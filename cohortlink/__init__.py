"""Extraction and linkage of records about people, as Spark jobs."""

from .functions.redact import mask_preview, mask_user, redact, redact_dates, redact_secrets
from .functions.similarity import similarity, weighted_ratio
from .functions.text import clean_html, clean_strings
from .model import LinkConfig
from .operators.catalog import (catalog_of, discover_key_tables, list_tables, session_catalog, table_columns,
                                table_summary)
from .operators.link import TableSpec, link_tables
from .operators.linkage import (best_matches, check_fuzzy, compact_matches, flat_matches, fuzzy_link, fuzzy_outcomes, fuzzy_top,
                                fuzzy_search)
from .operators.lookup import (all_patients, by_birth_years, by_demographics, by_id, by_last_name, demographic_misses,
                               demographic_outcomes, demographic_summary, id_failures, id_summary,
                               lookup_by_demographics, lookup_by_id, run_template)
from .operators.report import (distinct_people, grouped_report, json_documents, record_lines, redundant, report_rows,
                               section_rows, text_report, value_lines)
from .session import with_settings
from .sinks.runs import audit_log, login_line, operation_line, run_status, run_summary, search_line
from .sinks.writers import split_counts, split_key, write_reports, write_results
from .sources.requests import (demographic_requests, id_requests, number_rows, read_demographic_requests,
                               read_id_requests)
from .sources.tables import read_jdbc, read_parquet, read_table
