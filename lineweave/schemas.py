"""Column contracts of the tables that the plans read and write (survey 1.3)."""

from __future__ import annotations

CATALOG = "score_id string, path string, mxl string, title string, song_name string, artist_name string, composer_name string, genres string, rating string, n_ratings string, n_favorites string, n_views string, `subset:no_license_conflict` string, `subset:deduplicated` string, `subset:rated` string, `subset:rated_deduplicated` string"
