"""Word lists and rules that scoring and classification use; every function takes others as parameters."""

from __future__ import annotations

# ---- fixed values: lists, patterns and weights that results depend on ------------------------------------------------
DOMAIN_TERMS = {
    "policy": ("政策", "国务院", "外交部", "商务部", "央行", "证监会", "财政部", "国家", "中共中央", "监管", "法律", "条例", "办法", "发布会"),
    "international": ("美国", "特朗普", "白宫", "关税", "欧盟", "俄罗斯", "乌克兰", "伊朗", "以色列", "中东", "日本", "韩国", "印度", "访华", "制裁", "谈判", "停火"),
    "military": ("战争", "军事", "袭击", "导弹", "核", "浓缩铀", "停火", "军方", "航母", "防务"),
    "finance": ("黄金", "白银", "原油", "美元", "人民币", "美股", "A股", "港股", "股市", "债券", "利率", "降息", "通胀", "央行", "关税", "英伟达", "英特尔", "美光", "财报"),
    "tech": ("AI", "人工智能", "芯片", "半导体", "机器人", "模型", "OpenAI", "英伟达", "苹果", "特斯拉", "算力", "数据中心"),
    "society": ("事故", "通报", "调查", "地震", "火灾", "爆炸", "医院", "学校", "食品", "公共安全", "死亡", "救援", "儿童"),
    "entertainment": ("电影", "票房", "综艺", "明星", "演唱会", "剧集", "官宣", "热映", "定档"),
    "sports": ("世界杯", "比赛", "夺冠", "联赛", "球队", "球员", "体育"),
}
CATEGORY_RULES = {
    "policy": (
        (r"国务院|中共中央|全国人大|最高法|最高检|央行|证监会|财政部|商务部|发改委|国家统计局|网信办", 18),
        (r"政策|监管|法律|条例|规划|审议|挂牌督办", 16),
        (r"地方政府|市委|省委|问责", 10),
    ),
    "international": (
        (r"美国|特朗普|白宫|拜登|欧盟|俄罗斯|乌克兰|伊朗|以色列|日本|韩国|印度|英国|法国|德国", 12),
        (r"中美|访华|来华|外交|外长|总统|首相|大使|会晤|谈判|联合国", 16),
        (r"台湾问题|南海|国际观察", 12),
    ),
    "military": (
        (r"战争|军事|军方|袭击|空袭|导弹|航母|防务|武装|交火", 22),
        (r"核武|核设施|核谈判|核问题|核计划|浓缩铀|霍尔木兹|停火|军事行动", 18),
        (r"伊朗|以色列|美伊", 8),
    ),
    "finance": (
        (r"CPI|通胀|降息|利率|美联储|美元|人民币|汇率", 18),
        (r"央行|证监会|交易所|货币政策|适度宽松|降准|流动性|IPO", 18),
        (r"美股|A股|港股|股市|沪指|纳指|标普|道指|中概股|ETF|期货|债券|基金|财报|营收|利润", 18),
        (r"黄金|白银|贵金属|原油|布油|油价|大宗商品", 20),
        (r"关税|经贸|贸易|出口|进口|供应链|制裁|反制", 24),
        (r"销量|汽车销量|车企|新能源车|油车|电动车", 12),
        (r"芯片股|半导体ETF|CPO|存储芯片", 12),
    ),
    "tech": (
        (r"AI|人工智能|大模型|模型|OpenAI|DeepSeek|机器人|算力|数据中心", 18),
        (r"芯片|半导体|英伟达|英特尔|AMD|高通|美光|苹果|华为|小米|特斯拉|宇树", 16),
        (r"发射|飞船|航天|天舟|卫星|火箭|探测器", 12),
    ),
    "society": (
        (r"事故|污染|中毒|救治|调查|通报|火灾|爆炸|地震|死亡|救援|医院|学校|儿童|偷拍|开除|违法|犯罪|谣言|被罚|退货|纠纷", 20),
        (r"新郎|新娘|婚礼|婚宴|结婚|走红毯|内裤|短裤|皮鞋|公共场合", 34),
        (r"新物种|物种|两头蛇|蛇类|普通蛇|野生动物|动植物|昆虫|灭绝|生态|自然保护|生物多样性|科普|科学发现|研究发现", 30),
        (r"女子|男子|女生|男生|老人|孩子|宝宝|病逝|失踪|法院|判决|维权|真伪|招商|拿地", 16),
        (r"存款|医保|房贷|就业|工资|高考|教育|食品|农田|公共安全|民生|消费者|生态|环境", 14),
        (r"汶川|可乐男孩|母亲|老人", 8),
    ),
    "entertainment": (
        (r"《[^》]+》.*(大结局|开播|播出|定档|上映|票房|选角|主演|导演|演员|剧情|剧集|电视剧|电影)", 34),
        (r"低智商犯罪|大结局|单更|选角|追剧|剧透|剧情|番外|收官", 30),
        (r"电影|票房|综艺|明星|演员|歌手|演唱会|剧集|电视剧|热映|定档|官宣|红毯|戛纳|电影节|白鹿|巩俐", 18),
    ),
    "sports": ((r"世界杯|比赛|夺冠|联赛|球队|球员|体育|国际足联|足球|篮球|NBA|CBA|中超|欧冠|英超|世预赛|网球|乒乓|羽毛球|电竞|AG超玩会|狼队|皇马", 18),),
}
CATEGORIES = ("policy", "international", "military", "finance", "tech", "society", "entertainment", "sports", "general")
IMPORTANT = (
    "国务院", "外交部", "商务部", "央行", "证监会", "财政部", "美国", "特朗普", "关税", "访华",
    "伊朗", "以色列", "俄罗斯", "乌克兰", "停火", "战争", "制裁", "谈判", "黄金", "白银",
    "原油", "美元", "人民币", "美股", "A股", "港股", "利率", "降息", "通胀", "AI", "芯片",
    "半导体", "英伟达", "事故", "调查", "通报", "地震", "爆炸", "死亡",
)
DIGEST_IMPORTANT = (
    "国务院", "外交部", "央行", "证监会", "最高法", "最高检", "国家统计局",
    "美国", "俄罗斯", "乌克兰", "以色列", "中东", "欧盟", "日本", "韩国",
    "关税", "利率", "通胀", "股市", "A股", "港股", "美股", "人民币",
    "AI", "芯片", "新能源", "机器人", "事故", "通报", "调查", "地震",
)
WATER = (
    "热映", "票房破", "定档", "开播", "路透", "晒照", "穿搭", "红毯", "机场", "花絮", "综艺",
    "小贴士", "赏花", "打卡", "文旅", "美食", "养生", "每坐30分钟", "小程序", "网友热议",
    "泪目", "太甜", "梦幻联动", "离谱", "尴尬", "神回复", "微信状态", "访客记录", "客服回应",
)
NOVELTY = ("首次", "突破", "超预期", "罕见", "突然", "反转", "重磅", "宣布", "批准", "恢复", "升级", "创历史")
FOLLOW_UP = ("将", "拟", "计划", "考虑", "谈判", "会晤", "调查", "通报", "审议", "制裁", "停火", "协议", "走势", "价格", "访华", "裁决")
CONTRAST = ("反转", "否认", "回应", "拒绝", "分歧", "僵局", "超预期", "暴涨", "暴跌", "无能狂怒", "翻车", "岌岌可危")
PROXIMITY = ("中国", "中方", "国内", "A股", "港股", "人民币", "央行", "证监会", "商务部", "普通人", "就业", "房贷", "医保")
DIGEST_TERMS = ("【早报】", "早报", "晚报", "早餐", "FM-Radio", "今夜看点", "环球市场", "8点1氪", "邦早报")
TRACKS = (
    ("trump-china-visit", ("特朗普|美国总统", "访华|中国之行|来华|对中国进行国事访问|中美元首")),
    ("tariff-war", ("关税|经贸磋商|贸易战|贸易谈判", "美国|中美|中国|特朗普")),
    ("gold-trend", ("黄金|白银|贵金属",)),
    ("us-iran", ("伊朗|美伊|浓缩铀|霍尔木兹", "美国|特朗普|以色列|停火|战争|军事")),
)
DEFAULT_WEIGHT, DEFAULT_TRUST = 8, 50
TITLE_NOISE, FEED_NOISE = ("热搜", "最新", "突发", "刚刚", "详情", "全文"), ("图文", "视频", "详情", "全文", "最新")
TITLE_SIGNS = r"#【】\[\]（）()《》“”\"'：:，,。.!！?？、\-_/|"
MOJIBAKE_SIGNS = "ÃÂâåäæçèéœ‰º¤¥"
#: id -> tier, type, weight, trust.
SOURCE_PROFILES = {
    "thepaper": ("权威媒体", "综合新闻", 16, 82),
    "ifeng": ("权威媒体", "综合新闻", 12, 72),
    "wallstreetcn-hot": ("财经专业源", "财经市场", 17, 84),
    "cls-hot": ("财经专业源", "财经市场", 16, 82),
    "sina-finance": ("财经专业源", "财经市场", 14, 76),
    "xueqiu-hotstock": ("市场热榜", "财经市场", 9, 62),
    "baidu": ("综合热榜", "综合热榜", 10, 58),
    "toutiao": ("综合热榜", "综合热榜", 10, 58),
    "weibo": ("社交热榜", "社交网络", 8, 46),
    "zhihu": ("社区讨论", "社区问答", 8, 54),
    "bilibili-hot-search": ("娱乐社区", "视频社区", 6, 44),
    "douyin": ("娱乐社区", "短视频", 6, 42),
}
DEFAULT_TIER, DEFAULT_TYPE = "普通来源", "综合来源"
SOURCE_HINTS = {"wallstreetcn-hot": "finance", "cls-hot": "finance", "sina-finance": "finance", "xueqiu-hotstock": "finance"}
#: Weights of the digest.
SOURCE_WEIGHTS = {
    "thepaper": 16, "wallstreetcn-hot": 15, "cls-hot": 15, "sina-finance": 13, "ifeng": 12, "baidu": 12,
    "toutiao": 11, "weibo": 11, "zhihu": 10, "xueqiu-hotstock": 9, "bilibili-hot-search": 8, "douyin": 8,
}
CATEGORY_LABELS = {
    "policy": "时政", "international": "国际", "military": "军事", "finance": "财经", "tech": "科技",
    "society": "社会", "entertainment": "文娱", "sports": "体育", "general": "综合",
}
TREND_STATES = ("升温", "持续", "扩散", "新近")
# ---- end of the fixed values ------------------------------------------------------------------------------------------
