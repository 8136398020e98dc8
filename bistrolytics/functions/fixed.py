"""Fixed values that results depend on. Nothing here is logic."""

# Ranking.
RRF_K = 60
VECTOR_WEIGHT = 0.6
CTR_WEIGHT = 0.4
SAME_CATEGORY_PENALTY = 0.5
CTR_PRIOR = 10
RECOMMEND_VERSION = "recommend_per_item_rrf_v2"
REASON_SIMILAR = "similar"
REASON_POPULAR = "combo+popularity"
FEEDBACK_TYPE = "RECOMMENDATION_CLICK"

# BM25.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
PAD_TOKEN = "_pad_"

# Characters that separate tokens (Unicode white space and U+001C..U+001F).
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Basket mining.
MIN_TRANSACTIONS = 5
SUPPORT_FLOOR = 0.001
SWEEP_SUPPORTS = (0.05, 0.03, 0.01, 0.005, 0.001)
TRAIN_SUPPORT = 0.03
TRAIN_CONFIDENCE = 0.5
SERVE_LIMIT = 20
TRAIN_LIMIT = 50

# Forecasting.
FEATURE_COLUMNS = (
    "lag_1", "lag_2", "lag_3", "lag_4", "lag_5", "lag_6", "lag_7",
    "roll_mean_7", "roll_std_7",
    "day_of_week", "is_weekend", "month",
)
MIN_HISTORY_DAYS = 14
MARGIN_SIGMAS = 1.5

# Kitchen batching.
WAIT_POINTS = 2
TASK_POINTS = 5
OVERLOAD_POINTS = 15
STATION_CAPACITY = 5
WAIT_CAP_MINUTES = 60
SAVING_CAP_MINUTES = 15.0
BATCH_REASON = "Same item high queue overlap"

# Request limits.
LIMIT_CAPACITY = 60
LIMIT_REFILL = 1.0
CHAT_LIMIT_CAPACITY = 15
CHAT_LIMIT_REFILL = 0.25

# Short confirmations that need no retrieval.
ACK_TOKENS = (
    "ok", "okay", "okela", "oke", "okê", "okie", "k",
    "ừ", "ừm", "uh", "uhm", "ờ", "ờm",
    "vâng", "dạ", "dạ vâng", "dạ được",
    "có", "đúng", "phải", "yep", "yes", "y",
    "đồng ý", "ổn", "được", "được ạ", "ok ạ",
    "rồi", "rồi ạ",
)

# Catalog and chat text formats.
FULL_TEXT_LABELS = ("Tên: ", ", Giá: ", ", Mô tả: ", ", Danh mục: ", ", Đặc tính: ")
CONTEXT_HEADER = "Danh sách món ăn phù hợp:"
CONTEXT_LABELS = ("  ID: ", " | ", " | Giá: ", "đ | ", " | Đặc tính: ")
CONTEXT_EMPTY = "Hiện không có thông tin menu. Hãy tư vấn dựa trên mô tả của khách."
NO_MENU_REPLY = (
    "Chưa có thông tin menu ạ. Quý khách vui lòng cho tôi biết món mình muốn tìm "
    "hoặc mô tả nhu cầu cụ thể hơn."
)
ACK_CONTEXT = (
    "Khách vừa trả lời xác nhận ngắn (ví dụ: 'ok', 'ừ', 'vâng'). "
    "KHÔNG có danh sách món mới. Hãy dựa vào lịch sử hội thoại: "
    "nếu lượt trước bạn đã đề xuất ĐẶT một món cụ thể, gọi add_to_cart với món đó; "
    "ngược lại, hỏi lại khách muốn đặt món nào."
)
CART_TOOL = "add_to_cart"
DEFAULT_REPLY = "Dạ em ghi nhận ạ!"
