"""Declared contracts: ordered columns, types and closed vocabularies. Nothing is inferred from data."""

from __future__ import annotations

PV = "source string, year int, state string, candidate string, party string, candidate_votes long, state_total_votes long, reliability string"
PV_COLUMNS = ["source", "year", "state", "candidate", "party", "candidate_votes", "state_total_votes", "reliability"]
#: Years of the parsed nested record: two result tables a year.
YEAR_RECORD = (
    "year int, t1 array<struct<president_candidate_name:string, president_candidate_party:string>>,"
    " t2 struct<candidate_state:array<struct<president_candidate_name:string, col_ind:int, president_candidate_state:string>>,"
    " votes_by_state:array<struct<state:string, total_electoral_votes:int, votes:map<int,int>>>, contested_cells:array<struct<state:string, col_ind:int>>>"
)

# Output column order of the published relations. Columns are appended, never inserted.
JOINED_COLUMNS = [
    "year", "state", "candidate_id", "candidate", "total_electoral_votes", "president_electoral_votes", "national_electoral_votes",
    "president_electoral_rank", "took_office", "source", "party", "candidate_votes", "state_total_votes", "reliability", "redistributable",
    "president_electoral_votes_counted", "national_counted_electoral_votes", "count_status", "count_status_reason",
]
MEASURE_COLUMNS = [
    "year", "candidate_id", "candidate", "party", "national_electoral_votes", "national_counted_electoral_votes", "ec_denominator", "ec_share_full",
    "national_pv_votes", "national_pv_denominator", "pv_share", "ec_share_hybrid", "pv_coverage", "hybrid_score", "president_electoral_rank", "took_office",
]
SUMMARY_COLUMNS = [
    "year", "ec_denominator", "ec_winner", "pv_winner", "hybrid_winner", "ec_determinative", "pv_coverage", "pv_flip", "hybrid_flip",
    "ec_margin", "pv_margin", "hybrid_margin",
]
SNAPSHOT_COLUMNS = [
    "year", "state", "state_usps", "candidate", "candidate_slug", "total_electoral_votes", "president_electoral_votes", "national_electoral_votes",
    "president_electoral_rank", "took_office", "source", "party", "candidate_votes", "state_total_votes", "reliability", "pv_status",
    "president_electoral_votes_counted", "national_counted_electoral_votes", "count_status", "count_status_reason",
]
ROLLUP_COLUMNS = [
    "year", "candidate", "candidate_slug", "party", "national_electoral_votes", "president_electoral_rank", "took_office", "national_pv_votes",
    "national_pv_denominator", "national_counted_electoral_votes", "national_electoral_denominator",
]
# Columns of the delimited source, vocabularies, and marks of an absent number.
CSV_COLUMNS = [
    "year", "state", "state_po", "state_fips", "state_cen", "state_ic", "office", "candidate", "party_detailed", "writein",
    "candidatevotes", "totalvotes", "version", "notes", "party_simplified",
]
PV_STATUSES = ["popular_vote", "legislature_chosen", "not_participating"]
COUNT_STATUSES = ["counted", "not_counted", "disputed"]
ABSENT_TOKENS = ["", "--", "-", "---"]

