"""Fixed values that results depend on, kept together and in plain form."""

# Numerical guards added to denominators.
EPS = 1e-12
SCALE_EPS = 1e-6

# Rolling window lengths, in rows.
SPANS = (5, 10, 20, 30, 60)
POSITION_SPANS = (20, 60, 120)
CONTEXT_SPANS = (5, 10, 20, 60)

# Order of the 96 factor columns (a contract with anything that stores them by position).
FACTOR_COLUMNS = (
    ["ret", "ret_abs", "pvo", "sse", "liq", "skew", "gap", "vts", "vcll", "rvr", "csl", "rev",
     "vcbl", "kurtosis", "lip", "vol_per_trade"]
    + [name for n in SPANS for name in (f"ma{n}", f"ema{n}", f"price_ma{n}_ratio", f"ma{n}_slope")]
    + ["ma5_10_cross", "ma10_20_cross", "ma20_60_cross", "rsi14", "rsi5",
       "macd_dif", "macd_dea", "macd_hist", "boll_ma20", "boll_width", "boll_pctb",
       "atr14", "hl_range", "candle_body", "candle_upper", "candle_lower",
       "body_ratio", "upper_ratio", "lower_ratio",
       "turnover", "turnover_ma20_ratio", "turnover_std20_ratio",
       "price_turnover_corr20", "volume_price_corr20", "vol_std20_over_mean20", "vol_cv_20"]
    + [name for n in SPANS for name in (f"mom{n}", f"mom{n}_z")]
    + [name for n in SPANS for name in (f"ret_std{n}", f"ret_mean{n}")]
    + [name for n in SPANS for name in (f"turnover_mean_ratio_{n}", f"turnover_std_ratio_{n}")]
    + [f"price_pos_{n}" for n in POSITION_SPANS]
    + ["vol_ret_corr20_lag1"]
)

# Date spellings accepted on input, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd/MM/yyyy", "MM/dd/yyyy")

# Encodings a delimited file may use.
TEXT_ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "latin-1")

# Header synonyms of the stock master and of the classification table.
CODE_NAMES = ("code", "order_book_id", "stock_code", "ticker")
IPO_NAMES = ("ipo_date", "ipo", "list_date", "上市日期")
DELIST_NAMES = ("delist_date", "退市日期", "退市", "de_list_date")
MAP_KEY_NAMES = ("order_book_id", "code", "stock_code", "ticker")
MAP_VALUE_NAMES = ("industry", "industry_name", "sector", "industry_cn")

# A delisting date after this one means "still listed".
NEVER_DELISTED_AFTER = "2100-01-01"

# Boards by exchange suffix and code prefix.
BOARD_PREFIXES = {"STAR": ("XSHG", ("688", "689")), "CHINEXT": ("XSHE", ("300", "301"))}
BOARD_SUFFIXES = {"BSE": ("XBEI", "XBSE"), "NEEQ": ("XNE", "XNEE", "XNEQ", "XNEX", "NEEQ")}

# Spellings of a raised flag.
TRUE_SPELLINGS = ("TRUE", "True", "true", "1", "1.0")

# Parameter grid of the stop-rule sweep; 99 switches a rule off.
TAKE_PROFIT_GRID = (0.05, 0.10, 0.15, 0.20, 99.0)
STOP_LOSS_GRID = (0.03, 0.05, 0.10, 99.0)
COOLDOWN_GRID = (1, 3, 5, 10)

# Market proxy name patterns, in order of preference.
MARKET_PROXY_PATTERNS = ("000300", "CSI300", "HS300")
