"""Fixed values of the matching model and the size bounds of the plans."""

# --- fixed values of the model (they decide results) -------------------------

# Neighbourhood vectors.
NEIGHBOURS = 4
SUM_BOUND = 72.0
ANGLE_WEIGHT = 0.421875
BOX_X, BOX_Y, BOX_TH = 250, 250, 96
MIN_DIST, MAX_DIST = 0.0, 800000.0
ALIGN_DIST, ALIGN_ANGLE = 8.0, 3.141592653589793 / 6
SEEDS = 5

# Cylinder codes.
GRID, LEVELS = 8, 6
CELLS = GRID * GRID * LEVELS
CYL_RADIUS, HULL_MARGIN, CELL_RADIUS = 70, 50, 28
CONTEXT_RADIUS = CYL_RADIUS + CELL_RADIUS
MIN_CONTEXT = 4
CELL_STEP, GRID_SHIFT = 17.5, 4.5
GAUSS_SCALE, GAUSS_RATE = 0.042743816, 0.005739796
INV_SIGMA_D = 1.43239448783
CELL_MU, CELL_TAU = 0.01, 400.0
MAX_INVALID_CELLS = 174
MIN_COMMON_CELLS = 230
MAX_TURN = 64
LEVEL_DIRECTIONS = (-106, -64, -21, 21, 64, 106)

# Consolidations.
NP_MIN, NP_MU, NP_TAU = 4, 20.0, 3.2
IMPROVED_TOP = 10
LOCAL_THRESHOLD = 500_000          # 0.5 in millionths
RELAX_ROUNDS, RELAX_WEIGHT = 5, 0.5
RHO_DIST = (5.0, -1.6)
RHO_ANGLE = (0.261799387799, -30.0)
DEG_TO_RAD = 0.017453293

# --- size bounds of the plans (they never change results) --------------------

# A fingerprint up to this many minutiae is one row handled by one task;
# a larger one takes the relational path of operators/oversize.py.
MAX_ROW_MINUTIAE = 1024
# Probe sets are broadcast in blocks of at most this many local structures.
MAX_BROADCAST_LS = {"jiang": 200_000, "cylinder": 20_000}
