"""Status literals. These are data values and must stay byte-exact."""

# Fixed values.
MATCH, MISMATCH, PARTIAL = "匹配", "不匹配", "部分匹配"
UNREAD, UNDECIDABLE, REVIEW = "未识别", "无法判断", "需人工复核"
PASS, REJECT, FAILED = "通过", "不通过", "识别失败"
WAITING, UNCHECKED, UNCONFIRMED = "待结果", "未核对", "匹配待确认"
CORRECT, WRONG, ERROR = "正确", "错误", "失败"
NO_TRUTH, NOT_RUN, UNTESTED, TESTING = "待标注", "未运行", "未测试", "测试中"
SCORED = (CORRECT, WRONG, UNREAD, ERROR)
