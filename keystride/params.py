"""Default parameters shared by the public functions."""

# Public defaults.
K = 10                      # completions returned per prefix
TRENDING_SIZE = 10          # rows of a trending list
ALPHA = 0.5                 # weight of popularity in the blended score
HALF_LIFE_SECONDS = 3600.0  # age at which a search counts half
FLUSH_THRESHOLD = 500       # events that close a flush
FLUSH_INTERVAL_SECONDS = 5  # time that closes a flush
VIRTUAL_NODES = 150         # ring positions per node
TTL_POPULARITY_SECONDS = 60
TTL_RECENCY_SECONDS = 15
TTL_TRENDING_SECONDS = 15
DEBOUNCE_SECONDS = 0.2
MAX_QUERY_LENGTH = 512      # UTF-16 units

# Bounds of ours.
MAX_GROUP_ROWS = 1_000_000  # a larger window group is split over many tasks
MAX_BROADCAST_ROWS = 200_000  # a larger side is joined by shuffling


def candidate_pool(k: int = K) -> int:
    """Rows per prefix that are re-ranked when recency is asked for."""
    return max(5 * k, 50)


def leader_count(size: int = TRENDING_SIZE) -> int:
    """Score leaders from which a trending list is drawn."""
    return max(3 * size, size)
