"""These must equal the original workload's for equal results."""

# Test rows of a class of size n: n < 3 -> 0, n <= 5 -> 1, n <= 10 -> 2,
# n < 100 -> int(8/90 * n + 10/9), else int(n * test_ratio)
SPLIT_NONE_BELOW = 3
SPLIT_ONE_UP_TO = 5
SPLIT_TWO_UP_TO = 10
SPLIT_LINEAR_BELOW = 100
SPLIT_SLOPE = (8.0, 90.0)        # 8 / 90
SPLIT_INTERCEPT = (10.0, 9.0)    # 10 / 9

# Bagging: classes with at most this many rows are taken whole
MIN_CAT_DATA = 2
# Random class sizes: initial size cut and its decrement
CUT_STD = 1000
CUT_STEP = 100

# Losses: log offset, focal alpha and gamma
EPS = 1e-9
FOCAL_ALPHA = 1.0
FOCAL_GAMMA = 2.0

# Subset ranking: weighted score = 0.6 * accuracy + 0.4 * macro F1; top 5
W_ACC = 0.6
TOP_K = 5

# Upsampling minimum and rounding of metrics / argmax inputs
UPSAMPLE_MINIMUM = 500
METRIC_PLACES = 6
ARGMAX_PLACES = 9
