"""Tables of a fact store, its limits and its configuration."""

from dataclasses import asdict, dataclass, fields

from .errors import ConfigMismatch, Invalid

#: ``valid_to`` of what is still open.
OPEN = 9223372036854775807

FACTS = (
    "fact_id long, entity_id long, text string, tags array<string>, metadata map<string,string>, revises long, "
    "recorded_at long, valid_from long, valid_to long, tombstone boolean, vector struct<scale:double,q:array<tinyint>,sig:array<long>>"
)
LENGTHS = "fact_id long, n long"
POSTINGS = "term string, fact_id long, tf int, len int, bucket int"
# The vector index: every vector under its cell, and the cells' centres.
CELLS = "slot long, vector struct<scale:double,q:array<tinyint>,sig:array<long>>, cell int"
CENTRES = "cell int, centre array<float>"
#: Folders that a store's postings are kept in, by a hash of the term.
BUCKETS = 16
ENTITIES = "entity_id long, name string, norm_name string, created_at long"
# What later generations changed in rows that stand in earlier folders.
FACT_CHANGES = "fact_id long, valid_to long, tombstone boolean"
EDGE_CHANGES = "edge_id long, valid_to long"
EDGES = "edge_id long, src long, rel string, rel_ord long, dst long, provenance long, recorded_at long, valid_from long, valid_to long"

# Hard limits of recall and of the write verbs.
SOURCE_CAP = 128
GRAPH_ENTITY_CAP, GRAPH_FACT_CAP, GRAPH_EDGE_CAP, GRAPH_EXAMINE_CAP = 64, 256, 128, 2048
STOP_DF_DIVISOR, STOP_DF_FLOOR = 8, 1024
SIMILAR_RING, SIMILAR_MOST = 32, 8
MAX_TAGS, MAX_LINKS = 32, 16
TAG_PAGE, TAG_PAGE_MAX = 64, 256
K_DEFAULT, K_MAX, BUDGET_DEFAULT = 8, 64, 512
SPACE_ID_MAX = 256
# Bits of a result's sources.
BM25, GRAPH, TIME, VEC = 1, 2, 4, 8


@dataclass(frozen=True)
class Config:
    dim: int = 0
    max_text: int = 4096
    max_blob: int = 65536
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: float = 60.0
    w_bm25: float = 1.0
    w_vec: float = 1.0
    w_graph: float = 1.0
    w_time: float = 1.0
    w_recency: float = 0.25
    half_life_days: float = 180.0
    graph_depth: int = 2
    graph_decay: float = 0.5
    similar_cos: float = 0.85
    similar_jaccard: float = 0.5
    flat_to_hnsw: int = 24000
    db_uuid: str = ""

    def validate(self) -> "Config":
        ok = {
            "dim": 0 <= self.dim <= 4096,
            "max_text": 0 < self.max_text <= self.max_blob,
            "bm25_k1": self.bm25_k1 >= 0,
            "bm25_b": 0 <= self.bm25_b <= 1,
            "rrf_k": self.rrf_k > 0,
            "w_recency": self.w_recency >= 0,
            "half_life_days": self.half_life_days > 0,
            "graph_decay": 0 < self.graph_decay <= 1,
            "similar_cos": 0 <= self.similar_cos <= 1,
            "similar_jaccard": 0 <= self.similar_jaccard <= 1,
        }
        for name, fine in ok.items():
            if not fine:
                raise Invalid(f"config: {name} = {getattr(self, name)}")
        return self

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "Config":
        return cls(**{f.name: d[f.name] for f in fields(cls) if f.name in d}).validate()

    #: What may differ when a store is opened again: the recall settings.
    TUNABLE = frozenset({"rrf_k", "w_bm25", "w_vec", "w_graph", "w_time", "w_recency", "half_life_days", "graph_depth", "graph_decay", "similar_cos", "similar_jaccard", "flat_to_hnsw"})

    def reconciled(self, stored: "Config") -> "Config":
        """This configuration for a store written with ``stored``."""
        for f in fields(self):
            mine, theirs = getattr(self, f.name), getattr(stored, f.name)
            if f.name not in self.TUNABLE and mine != theirs and mine != f.default:
                raise ConfigMismatch(f"{f.name}: {mine!r} asked for, {theirs!r} stored")
        return Config.from_dict(stored.to_dict() | {n: getattr(self, n) for n in self.TUNABLE})
