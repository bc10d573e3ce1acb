"""Fixed values.

Word lists, patterns, labels, thresholds and column names that results depend on.
They are data: every operator takes them as parameters with these defaults.
"""

# --- fixed values: characters -------------------------------------------------
UNIT_CHARS = "包袋箱件个条"
COUNT_UNITS = ["箱", "件", "袋", "包", "个", "瓶", "桶", "条", "盒", "台"]
DEFAULT_UNIT = "件"

# --- fixed values: specification patterns, tried in this order (case-insensitive)
SPEC_PATTERNS = [
    r"\d+KG\s*[*×]\s*\d+[包袋箱件个条]",
    r"\d+[包袋箱件个条]\s*[*×]\s*\d+KG",
    r"\d+[包袋箱件个条]/\d+[包袋箱件个条]",
    r"\d+[包袋箱件个条]\s*[*×]\s*\d+[包袋箱件个条]",
]

# --- fixed values: words of the core-word gate ---------------------------------
PRODUCT_FORMS = ["鸡排", "片", "肠", "翅", "腿", "排", "羊排", "牛排", "蟹", "虾", "鱼", "肉", "丸子"]
SEASONING_WORDS = ["酱料", "粉", "膏"]

# --- fixed values: match weights and acceptance limits --------------------------
MATCH_WEIGHTS = {
    "L2": {"name": 0.50, "spec": 0.20, "boost": 0.00},
    "L2.5": {"name": 0.45, "spec": 0.20, "boost": 0.10},
    "L3": {"name": 0.45, "spec": 0.20, "boost": 0.10},
}
UNIT_BONUS = 0.20
SPEC_BONUS = 0.10
TIE_GAP = 0.001
LAYER_ORDER = ["L0", "L1", "L1b", "L2", "L2.5", "L3"]
EQUAL_LAYER_CONFIDENCE = {"L0": 0.98, "L1": 0.95, "L1b": 0.93}

# --- fixed values: store names --------------------------------------------------
INVALID_STORE_PREFIXES = ["店铺", "门店", "SN", "PN"]
REGION_PREFIXES = ["河北-", "天津-", "沧州-"]
PLACE_SUFFIXES = ["省", "市", "区", "县", "镇", "乡", "村", "街", "路", "店", "仓", "口"]
WAREHOUSE_SUFFIXES = ["仓", "仓店", "仓储"]

# Names under which an answer may carry the key of the store it confirms, the first non-empty one wins.
CONFIRMATION_KEYS = ["_store_key", "store_key", "store_name_submitted", "store_name"]

# --- fixed values: labels of text orders, first label that fits wins --------------
LINE_LABELS = {
    "order_no": ["订单编号", "订单号", "单号"],
    "store_name": ["公司名称", "门店名称", "门店", "客户名称", "店名"],
    "contact_person": ["联系人", "收货人", "收货人姓名", "收件人"],
    "phone": ["联系电话", "手机号", "手机", "电话"],
    "address": ["收货地址", "地址", "配送地址"],
}
SPEC_MARKERS = r"(规格|件：|箱：|袋：|kg|KG|g|G|[*×])"
TOTAL_WORDS = ["合计", "总计"]

# --- fixed values: default column-name aliases --------------------------------------
FIELD_ALIASES = {
    "product_name": ["商品名称", "商品名", "品名", "货品名称", "产品名称", "产品名", "货品", "商品", "名称", "name", "product"],
    "product_spec": ["规格", "包装规格", "商品规格", "包装", "尺寸", "spec"],
    "quantity": ["数量", "订购量", "件数", "订货数量", "出库数量", "订单数量", "配送数量", "qty", "num"],
    "unit": ["销售单位", "单位", "计量单位", "包装单位", "件", "箱"],
    "remark": ["备注", "备注信息", "备注说明", "note", "配送备注"],
    "store_name": ["往来单位名称", "门店名称", "门店", "收货门店", "店铺名称", "店铺", "店名", "客户名称", "收货方", "store", "store_name"],
    "store_phone": ["结算单位电话", "联系电话", "电话", "手机号", "手机", "联系手机", "tel"],
    "store_address": ["结算单位详细地址", "详细地址", "地址", "收货地址", "配送地址"],
    "raw_order_no": ["订单号", "单号", "订单编号", "送货单号", "order_no"],
    "order_date": ["订单日期", "下单日期", "单据日期", "日期", "date", "叫货日期", "配送日期"],
    "extra_notes": ["备注", "订单备注"],
    "warehouse": ["仓库名称", "仓库", "warehouse", "发货仓库", "配送仓库"],
    "shipper_name": ["货主公司", "货主名称", "货主"],
    "contact_person": ["联系人", "收货人", "联系人姓名", "收货人姓名"],
}
REQUIRED_FIELDS = ["product_name", "quantity"]

# --- fixed values: edit instructions ------------------------------------------------
CONFIRM_WORDS = ["没问题", "确认", "通过", "生成吧", "可以", "好的", "确认生成"]
CANCEL_WORDS = ["取消", "算了", "不要了"]
EDIT_ROW = r"第(\d+)行"
EDIT_VALUE = r"(?:应该是|改成|是)([^(|\n]+)"
# Words for fields, each with the field it edits; then the words that may stand in an edit of all rows.
EDIT_FIELDS = [
    ("SKU", "sku_code"), ("系统SKU", "系统SKU"), ("出库单位", "outbound_unit"), ("单位类型", "unit_type"),
    ("商品名称", "商品名称"), ("数量", "quantity"), ("规格", "customer_spec"),
]
ALL_FIELDS = [("出库单位", "outbound_unit"), ("单位类型", "unit_type"), ("SKU", "sku_code"), ("数量", "quantity")]
EDIT_ALL = "所有({})(?:都)?改成(.+)"

# --- fixed values: user actions, first rule that fits wins ---------------------------
# (action, words looked up in the lower-cased text, words looked up in the text)
USER_ACTIONS = [
    ("confirm", ["confirm"], ["确认"]),
    ("reject", ["reject"], ["拒绝"]),
    ("modify", ["modify"], ["修改", "改"]),
    ("accept", ["yes"], ["对", "正确"]),
    ("reject", ["no"], ["错"]),
]

# --- fixed values: outbound order columns (order matters) and their defaults ---------
OUTBOUND_COLUMNS = [
    "seq_no", "store_code", "store_third_code", "warehouse_code", "urgency",
    "sku_code", "third_spec_code", "unit_type", "quantity", "stock_status",
    "outbound_type", "delivery_mode", "vehicle_type", "advance_pay", "pay_method",
    "courier", "unit_price", "total_amount", "batch_required", "batch_no",
    "production_date", "remark", "manufacturer_code", "store_address_code", "third_order_no",
    "business_mode", "business_type", "receiver", "phone", "address", "consumer_courier",
]
OUTBOUND_DEFAULTS = {
    "urgency": "0", "stock_status": "正常", "outbound_type": "201", "delivery_mode": "共配",
    "advance_pay": "否", "batch_required": "否",
}

# --- fixed values: alert and decision limits (rates are fractions) -------------------
MATCH_RATE_BANDS = [("critical", 0.50), ("high", 0.70), ("medium", 0.80)]
TIMEOUT_BANDS = [("high", 300000), ("medium", 180000)]
MAX_REJECTS = 2
DECISION_LIMITS = {
    "match_rate_warning": 0.85, "match_rate_critical": 0.70,
    "low_conf_warning": 0.10, "low_conf_critical": 0.20,
    "intervention_warning": 0.15, "intervention_critical": 0.30,
    "volume_warning": 10, "volume_dead": 3, "trend": 0.05,
}

DECISION_ADVICE = {
    ("match_rate", "critical"): "立即优化 SKU 匹配算法",
    ("match_rate", "warning"): "计划优化 SKU 匹配算法",
    ("low_confidence", "critical"): "优先解决低置信度商品匹配问题",
    ("low_confidence", "warning"): "关注低置信度商品，优化匹配规则",
    ("intervention", "critical"): "立即优化用户体验，减少手动确认",
    ("intervention", "warning"): "优化操作流程，降低用户干预频率",
    ("trend", "warning"): "分析下降原因，及时修复",
    ("volume", "critical"): "评估 Skill 价值，考虑优化功能或暂时下线",
    ("volume", "warning"): "推广 Skill 使用，增加用户活跃度",
}

# --- fixed values: analysis windows ---------------------------------------------------
ALIAS_LOOKBACK_DAYS, ALIAS_MIN_COUNT, ALIAS_TOP = 7, 3, 20
LAYER_MIN_ATTEMPTS = 50
TUNING_LOOKBACK_DAYS, TUNING_MIN_TOTAL, TUNING_FLAG_PERCENT = 30, 10, 30.0
DAILY_ALIAS_DAYS, DAILY_ALIAS_MIN = 1, 2

# --- fixed values: text jobs ------------------------------------------------------------
INDEX_STOP_WORDS = [
    "the", "and", "for", "with", "this", "that", "from", "have", "are", "was", "were", "been", "will",
    "would", "could", "should", "def", "class", "import", "return", "self", "True", "False", "None",
    "的", "是", "在", "了", "和", "也", "都", "就", "不", "要", "有", "没", "上", "下", "用", "对", "为", "而",
    "于", "到", "这", "那",
]
FACT_WORDS = ["完成", "写", "做", "改", "加", "添加", "创建", "修复", "发现", "加入", "实现", "生成", "测试"]
REASON_WORDS = ["触发", "因为", "原因", "理由", "由于", "老板", "用户", "指出", "要求", "指定", "问"]
TITLE_SUFFIXES = [
    r"-企业信息查询黄页-.*$", r"-批发价格-优质货源-?.*$", r"公司介绍-联系方式.*$", r"联系方式.*$", r"-.*官网$",
]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MOBILE = r"1[3-9]\d{9}"
LANDLINE = r"(?:\+86\s?)?0?\d{2,4}[)-]\d{7,8}"
PUBLIC_MAIL_DOMAIN = "qq.com"
CONTACT_PATTERNS = [r"联系人[：:\s]*([^\s,，。\n]{2,10})", r"经理[：:\s]*([^\s,，\n]{2,8})"]

# --- fixed values: tool names of the argument summary ------------------------------------
PARSE_TOOLS = ["tools_parse", "order_parser"]
COMMAND_TOOLS = ["execute", "exec"]
STORE_TOOL = "_match_store"
SKU_TOOL = "_match_sku"
OUTPUT_TOOLS = ["template_generator", "_generate_multi_store_template"]

# --- fixed values: events ----------------------------------------------------------------
EVENT_TYPES = [
    "store_confirm_needed", "store_confirmed", "store_corrected", "sku_confirm_needed", "sku_confirmed",
    "sku_corrected", "order_complete", "order_cancelled", "user_modified", "alert_raised",
]
