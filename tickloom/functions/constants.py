"""Parameters and word lists whose content decides results."""

# Trading session, minutes since midnight, and bar lengths.
SESSION_OPEN_MIN = 555
SESSION_MINUTES = 375
TIMEFRAME_MINUTES = {"3": 3, "15": 15, "D": 375}

# Surge scan moving-average lengths and ticker renames.
FAST_LEN, SLOW_LEN, BASE_LEN = 8, 21, 89
TICKER_RENAMES = {"LTIM": "LTM"}

# Signal codes.
NEUTRAL, LONG, SHORT, ENTER_LONG, ENTER_SHORT, EXIT_LONG, EXIT_SHORT = range(7)
SIGNAL_TEXT = {5: "XU", 6: "XD", 3: "U", 4: "D", 1: "Up", 2: "Dn", 0: "Na"}
UP, DOWN, FLAT = 1, 2, 0

# Oscillator parameters.
MA_BUNDLE = (8, 21, 55, 233)
RSI_LEN, RSI_MA_LEN, SMOOTH_LEN, SIGNAL_LEN, STDEV_LEN = 8, 13, 3, 13, 89
RSI_CENTER = 50
KST_ROC = (8, 13, 21, 34)
KST_MA = (8, 8, 8, 13)
TREND_RANGE, TREND_THRESHOLD = 20, 5.2
RAD_TO_DEG = 180.0 / 3.14159265359
TRIGGER_ATR_LEN = 5

# Option strike steps per underlying, then by price band.
INDEX_STRIKE_STEP = {
    "NIFTY": 100,
    "NIFTY50": 100,
    "BANKNIFTY": 100,
    "FINNIFTY": 100,
    "MIDCPNIFTY": 100,
    "SENSEX": 100,
    "BANKEX": 100,
    "NIFTYNXT50": 100,
}
COMMODITY_STRIKE_STEP = {
    "GOLD": 1000,
    "GOLDM": 1000,
    "GOLDPETAL": 100,
    "SILVER": 5000,
    "SILVERM": 5000,
    "SILVERMIC": 1,
    "CRUDEOIL": 100,
    "CRUDEOILM": 100,
    "NATURALGAS": 10,
    "NATURALGASM": 10,
    "COPPER": 10,
    "ZINC": 1,
    "ZINIMINI": 1,
    "LEAD": 1,
    "LEADMINI": 1,
    "ALUMINIUM": 1,
    "ALUMIMINI": 1,
    "NICKEL": 10,
    "MENTHAOIL": 10,
    "COTTON": 10,
    "CASTORSEED": 10,
}
EQUITY_STRIKE_BANDS = [(100, 1), (250, 5), (500, 5), (1000, 10), (2500, 20), (5000, 50)]
EQUITY_STRIKE_DEFAULT = 100
FALLBACK_STEPS = [1, 2, 5, 10, 20, 25, 50, 100, 200, 500, 1000, 5000]

# Order segments.
OPTION_SEGMENTS = ["OPTSTK", "OPTIDX", "OPTFUT"]
FUTURE_SEGMENTS = ["FUTIDX", "FUTCOM", "FUTSTK"]
SEGMENT_SUFFIX = {
    "EQUITY": "EQ",
    "OPTFUT": "COMM",
    "FUTCOM": "COMM",
    "OPTIDX": "FNO",
    "OPTSTK": "FNO",
    "FUTIDX": "FNO",
    "FUTSTK": "FNO",
}
UNDERLYING_SEGMENT = {
    "OPTSTK": "EQUITY",
    "FUTSTK": "EQUITY",
    "OPTFUT": "FUTCOM",
    "OPTIDX": "INDEX",
    "FUTIDX": "INDEX",
}
PENDING_STATUSES = ["TRANSIT", "PENDING", "PART_TRADED", "ACTIVE", "CONFIRM"]

# Instrument master filters.
MASTER_EXCHANGES = ["NSE", "MCX"]
MASTER_SEGMENTS = [
    "EQUITY", "INDEX", "OPTSTK", "OPTIDX", "OPTFUT", "FUTIDX", "FUTCOM", "FUTSTK",
]
MASTER_TYPES = ["ES", "EQ", "OP", "FUT", "OPTFUT", "FUTCOM", "INDEX"]
CASH_SEGMENTS = ["EQUITY", "INDEX"]

# Search words and weights.
STOP_WORDS = ["OF", "THE", "&", "LTD", "LIMITED", "CORP", "CORPORATION", "CO"]
CALL_WORDS = ["CALL", "CE", "C", "CA"]
PUT_WORDS = ["PUT", "PE", "P", "PU"]
FUTURE_WORDS = ["FUT", "FUTURE", "FUTURES"]
INDEX_IGNORED = ["CE", "PE", "CALL", "PUT", "FUT", "OPT", "EQ"]
MONTH_WORDS = {
    "JAN": ["JAN", "JANUARY", "01"],
    "FEB": ["FEB", "FEBRUARY", "02"],
    "MAR": ["MAR", "MARCH", "03"],
    "APR": ["APR", "APRIL", "04"],
    "MAY": ["MAY", "05"],
    "JUN": ["JUN", "JUNE", "06"],
    "JUL": ["JUL", "JULY", "07"],
    "AUG": ["AUG", "AUGUST", "08"],
    "SEP": ["SEP", "SEPTEMBER", "09"],
    "OCT": ["OCT", "OCTOBER", "10"],
    "NOV": ["NOV", "NOVEMBER", "11"],
    "DEC": ["DEC", "DECEMBER", "12"],
}
SCORE_EXACT, SCORE_PREFIX, SCORE_IDF, SCORE_ALL, SCORE_EQUITY = 1000.0, 400.0, 100.0, 200.0, 50.0

# Ladder percentages and order defaults.
LADDER = {"entry": 0.13, "limit": 0.5, "target": 4.0, "stop": 0.7, "trail": 0.35}
OPTION_BUMP = 10
