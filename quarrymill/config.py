"""Settings with defaults; missing or unknown keys are errors."""

from __future__ import annotations

from dataclasses import dataclass, fields

from quarrymill.operators.entities import ADDRESS

#: Other names of keys; keys are read without regard to case.
ALIASES = {"result.2.neo4j": "result.to.graph", "result.2.postgresql": "result.to.tables", "geonames.country.code": "gazetteer.country", "geonames.max.rows": "gazetteer.max.rows", "geonames.dump.uri": "gazetteer.dump.uri", "geonames.zip.entry": "gazetteer.zip.entry"}


@dataclass(frozen=True)
class Settings:
    every_single_sentence: bool = False
    min_term_count: int = 5
    min_term_length: int = 2
    min_table_of_content: int = 80
    cleaning_regex: str = r"[^–\-\wäÄöÖüÜß,./]"
    with_stopword_filter: bool = False
    with_stemming: bool = False
    normalization: str = "none"
    word_window_size: int = 5
    iteration: int = 10
    with_vector_normalization: bool = True
    similarity: float = 66.0
    max_nearest: int = 10
    keyword_extractor_algorithms: tuple[str, ...] = ("tfidf", "textrank")
    keyword_filter_catalogs: tuple[str, ...] = ("alkis", "terms")
    max_distance_in_meters: float = 12_500.0
    max_street_count: int = 10
    max_section_count: int = 2
    min_named_entity_length: int = 5
    contains_in_synonyms: bool = False
    max_newlines: int = 5
    min_probability: float = 0.95
    address_regex: str = ADDRESS
    keyword_analyse: bool = True
    named_entity_analyse: bool = True
    result_to_graph: bool = True
    result_to_tables: bool = True
    origin_location_name: str = "Berlin"
    origin_location_latitude: float = 52.530644
    origin_location_longitude: float = 13.383068
    gazetteer_country: str = "DE"
    gazetteer_max_rows: int = 10
    gazetteer_dump_uri: str = ""
    gazetteer_zip_entry: str = ""

    @property
    def origin(self) -> tuple[float, float]:
        return self.origin_location_latitude, self.origin_location_longitude

    @classmethod
    def of(cls, values: dict[str, str], complete: bool = False) -> Settings:
        """From text values under dotted keys; with ``complete`` every key must be there."""
        values = {ALIASES.get(k.lower(), k.lower()): v for k, v in values.items()}
        known = {f.name.replace("_", "."): f for f in fields(cls)}
        if unknown := set(values) - set(known):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if complete and (missing := set(known) - set(values)):
            raise ValueError(f"missing settings: {sorted(missing)}")
        out = {}
        for key, text in values.items():
            default = known[key].default
            if isinstance(default, bool):
                out[known[key].name] = text.strip().lower() == "true"
            elif isinstance(default, tuple):
                parts = [p.strip() for p in text.split(",") if p.strip()]
                out[known[key].name] = tuple(type(default[0])(p) for p in parts)
            else:
                out[known[key].name] = type(default)(text)
        return cls(**out)

    @classmethod
    def load(cls, path: str, complete: bool = False) -> Settings:
        """From a properties file: ``key=value`` lines, ``#`` comments."""
        with open(path, encoding="utf-8") as f:
            lines = [x.strip() for x in f]
        return cls.of(dict((p.strip() for p in x.split("=", 1)) for x in lines if x and not x.startswith("#")), complete)

    def store(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            for x in fields(self):
                v = getattr(self, x.name)
                f.write(f"{x.name.replace('_', '.')}={','.join(map(str, v)) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else v}\n")
