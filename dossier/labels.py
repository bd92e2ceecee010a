"""Headings, keys and phrases of the record documents.

Fixed values: they must be what the documents hold, character by character.
Some labels occur in two spellings, one of them with radicals of the
compatibility block; both are listed where both are known.
"""

# Headings of sections.
BASIC = "基本資料"
CONTACT = ("聯絡⽅式", "聯絡方式")
WORK = ("⼯作經驗", "工作經驗")
EDUCATION = "教育背景"
SKILLS = ("才能專⻑", "才能專長")
INTRODUCTION = ("⾃我介紹", "自我介紹")
PREFERENCES = ("求職條件", "希望⼯作性質")

# Keys of the basic section.
NAME = ("姓/名", "姓名")
ENGLISH_NAME = ("英⽂名字", "英文名字")
CODE = "104代碼"
AGE = "年齡"
SCALARS = {
    "nationality": ("國籍",),
    "current_status": ("⽬前⾝份", "目前身份"),
    "earliest_start": ("最快可上班⽇", "最快可上班日"),
    "education_level": ("學歷",),
    "school": ("學校",),
    "major": ("科系",),
    "military_status": ("兵役狀況",),
    "desired_salary": ("希望薪資待遇",),
    "desired_industry": ("希望從事產業",),
    "years_of_experience": ("年資",),
}
JOB_CATEGORIES = "希望職務類別"
LOCATIONS = ("希望⼯作地點", "希望工作地點")
IDEAL_POSITIONS = "理想職務"
#: Keys that part flat text, in the order in which they are tried.
BASIC_KEYS = (
    "姓/名", "姓名", "英⽂名字", "英文名字", "104代碼",
    "年齡", "國籍", "⽬前⾝份", "目前身份", "最快可上班⽇", "最快可上班日",
    "⾝⼼障礙類別", "身心障礙類別",
    "學歷", "學校", "科系", "兵役狀況", "退伍時間",
    "希望薪資待遇", "希望職務類別", "希望⼯作地點", "希望工作地點",
    "希望從事產業", "理想職務", "語⾔", "語言", "年資", "特殊⾝份", "特殊身份",
    "最近⼯作", "最近工作", "相關職務經驗/年資",
    "駕駛執照", "交通⼯具", "交通工具",
    "個⼈簡介", "個人簡介", "個⼈格⾔", "個人格言", "個⼈特⾊", "個人特色",
    "個⼈連結", "個人連結",
)

# The personal summary inside the basic section, and what ends it.
SUMMARY = "個⼈簡介"
AFTER_SUMMARY = ("個⼈格⾔", "個⼈特⾊", "個⼈連結")

# Keys of the contact section.
CONTACTS = {
    "email": ("email",),
    "mobile1": ("⼿機1", "手機1"),
    "mobile2": ("⼿機2", "手機2"),
    "phone_home": ("住家",),
    "phone_work": ("公司",),
    "district": ("地區",),
    "mailing_address": ("通訊地址",),
}
CONTACT_KEYS = ("email", "聯絡⽅式", "聯絡方式", "⼿機1", "手機1", "⼿機2", "手機2", "住家", "公司", "地區", "通訊地址")

# Keys of a work entry; of the last two only values with text count.
WORK_FIELDS = {
    "industry": ("產業類別",),
    "company_size": ("公司規模",),
    "job_category": ("職務類別",),
    "management_responsibility": ("管理責任",),
    "job_title": ("職務名稱",),
}
WORK_TEXTS = {"job_description": ("⼯作內容", "工作內容"), "job_skills": ("⼯作技能", "工作技能")}
WORK_KEYS = ("產業類別", "公司規模", "職務類別", "管理責任", "職務名稱", "⼯作內容", "工作內容", "⼯作技能", "工作技能")

# Cells that mark header rows of the education table.
EDUCATION_HEADERS = ("學校", "教育背景")

# Keys of the preferences.
WISHES = {
    "work_type": ("希望⼯作性質", "希望工作性質"),
    "shift_preference": ("希望上班時段",),
    "remote_work_preference": ("遠端⼯作", "遠端工作"),
}

# Labels and header cells of the table of references and attachments.
REFERENCES = ("推薦⼈", "推薦人")
ATTACHMENTS = "附件"
PROJECTS = "專案成就"
OTHER_WORKS = "其他作品"
ATTACHMENT_HEADERS = ("#", "名稱", "姓名", "電⼦郵件", "電話", "檔案/連結", "說明")

# Labels of filters and display.
EXPERIENCE_RANGES = {"0-2年": (0, 2), "3-5年": (3, 5), "5-10年": (5, 10), "10年+": (10, None)}
SCORE_RANGES = ("80+", "60-79", "40-59", "<40", "No Score")
NO_EXPERIENCE = "無工作經驗"
DEFAULT_JOB = "Default Job"
TRUNCATED = "\n\n[... truncated ...]"
CANDIDATE_TITLE, JOB_TITLE = "候選人", "職位需求"
