"""Fixed values that must equal the reference's for identical results."""

# --- fixed values (reference behaviour) -----------------------------------
# Severity order used by trend analysis and ranking.
SEVERITY_ORDER = ["Critical", "High", "Medium", "Low", "Negligible", "Informational"]

# Severity colours.
SEVERITY_COLORS = {
    "Critical": "#d32f2f",
    "High": "#ffa000",
    "Medium": "#388e3c",
    "Low": "#1976d2",
    "Negligible": "#757575",
    "Informational": "#00bcd4",
}

# Palette for non-severity categories, picked by position modulo 10.
DEFAULT_COLORS = ["#7b1fa2", "#00796b", "#c2185b", "#512da8", "#0097a7",
                  "#689f38", "#5d4037", "#455a64", "#f57c00", "#303f9f"]

# Traffic-light tile geometry.
TILE_BOX_PADDING = 0.01
TILE_LABEL_Y = 0.80
TILE_VALUE_Y = 0.35
TILE_VALUE_Y_SINGLE = 0.5

# Weekday names, Monday first (weekday() == 0 is Monday).
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Trend-change colours.
COLOR_IMPROVED = "#2e7d32"
COLOR_WORSENED = "#c62828"
ICON_SUCCESS = "✅"
ICON_FAILURE = "❌"
ARROW_DOWN = "↓"
ARROW_UP = "↑"

# Table layout.
MAX_CELL_CHARS = 40
MIN_COLUMN_FRACTION = 0.08
HALF_WIDTH_FRACTION = 0.48

# Catalogue defaults and bounds.
DEFAULT_RETAIN = 10
MIN_RUN_GAP_SECONDS = 3600
ERROR_TEXT_CHARS = 500
HISTORY_DEFAULT_DAYS = 7
TREND_DAYS = 31
DEFAULT_REGION = "au1"
DEFAULT_ORIENTATION = "portrait"
FREQUENCIES = ["daily", "weekly", "monthly"]
BLOCK_TYPES = ["history", "trend_summary", "traffic_lights", "vertical_bar",
               "horizontal_bar", "pie_chart", "table", "divider"]

# Messages.
MSG_NO_ITEMS = "Unexpected API response format (no 'items' key)"
MSG_NO_ZONES = "Unexpected response format"
MSG_NO_DATA_KEY = "Unexpected response format (no 'data' key)"
MSG_NO_HISTORY = "No history data returned"
MSG_NO_DATA = "No data returned"
MSG_EMPTY = "No data to display"
MSG_NO_CHART = "Could not render chart"
MSG_NO_SCHEDULE = "No schedule configured"
MSG_NO_QUERY = "Query is required"
# --------------------------------------------------------------------------
