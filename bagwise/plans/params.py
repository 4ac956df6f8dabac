"""Fixed parameters of the registered queries (shared with the SQL oracle)."""

SPLIT_SEED = 5986        # hold-out split seed
NUM_TEST = 200           # rows requested for the hold-out set
BAG_SEED = 42
ESTIMATORS = 3
BAG_DIVISOR = 2          # rows requested per bag = training rows // BAG_DIVISOR
MIN_CAT = 2              # min_cat_data
NUM_SUB_VALID = 40       # valid rows requested per bag
UP_MIN = 8               # upsampling minimum
UP_SEED = 42
CUT_STD = 20             # class-size cut of the 'random' distribution
EMB_MODEL_TYPES = (("bert", 2), ("gpt", 2))   # learner types and counts
BATCH_SIZE = 32
EMB_CLASSES = 10
PATIENCE = 5
MAX_LEN = 50             # encoded length
VOCAB_SIZE = 30_000
FREQUENT = 500           # most frequent tokens, found with so many counters a task
FREQUENT_COUNTERS = 20_000
TOP_K = 5                # subset rankings
PREVIEW_N = 5
VIEW_OF_TYPE = {"bert": "word", "gpt": "char3"}
HEAD_EPOCHS = 15
TEXT_DIMS = 64           # hashed text features
TEXT_SCALE = 50.0
NETWORKS = 3             # networks trained together, their rows' share, losses and steps an epoch
NETWORK_SHARE = 0.5
NETWORK_LOSSES = ("CE", "FCE", "ICE")
NETWORK_HIDDEN = 16
NETWORK_EPOCHS = 6
NETWORK_STEPS = 8
