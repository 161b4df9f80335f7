"""Fixed values of the domain: taxonomy, keywords, ranks, triggers, templates, weights. Results depend on them as they stand."""

from __future__ import annotations

# Categories, kinds of user, and statuses of documents and items.
CATEGORIES = ["tax", "contracts_signing", "labor_insurance", "residence_civil", "business_licensing", "property_vehicles", "family_civil", "test_fixture"]
TEST_CATEGORY = "test_fixture"
ENTITY_TYPES = ["individual", "business", "both"]
DEFAULT_CATEGORY = "residence_civil"
UNCLASSIFIED = "Chưa phân loại"

INGESTIBLE_STATUSES = ["Còn hiệu lực", "Hết hiệu lực một phần", "Chưa có hiệu lực"]
ITEM_STATUSES = ["pending", "done", "dismissed"]

# The first keyword that a title holds decides.
CATEGORY_KEYWORDS = [
    ("thuế", "tax"), ("phí", "tax"), ("lệ phí", "tax"), ("kế toán", "tax"), ("ngân sách", "tax"),
    ("lao động", "labor_insurance"), ("việc làm", "labor_insurance"), ("tiền lương", "labor_insurance"), ("công đoàn", "labor_insurance"),
    ("bảo hiểm xã hội", "labor_insurance"), ("bảo hiểm y tế", "labor_insurance"),
    ("hợp đồng", "contracts_signing"), ("công chứng", "contracts_signing"),
    ("cư trú", "residence_civil"), ("hộ tịch", "residence_civil"), ("căn cước", "residence_civil"), ("hộ khẩu", "residence_civil"),
    ("doanh nghiệp", "business_licensing"), ("kinh doanh", "business_licensing"), ("giấy phép", "business_licensing"), ("đầu tư", "business_licensing"),
    ("chứng khoán", "business_licensing"),
    ("đất đai", "property_vehicles"), ("nhà ở", "property_vehicles"), ("phương tiện", "property_vehicles"), ("giao thông", "property_vehicles"),
    ("vận tải", "property_vehicles"),
    ("hôn nhân", "family_civil"), ("gia đình", "family_civil"), ("thừa kế", "family_civil"), ("ly hôn", "family_civil"), ("nuôi con nuôi", "family_civil"),
]

# Kinds of document that state no norms.
EXCLUDED_DOC_TYPES = [
    "ban_dich_van_ban", "cong_van", "thong_bao", "hiep_dinh", "nghi_dinh_thu", "ban_ghi_nho", "thoa_thuan", "van_ban_hanh_chinh_lien_quan",
    "van_ban_khac", "van_ban_lien_quan", "chuong_trinh", "chua_xac_dinh",
]

# Legal rank, 0 the highest.
INSTRUMENT_RANK = {
    "hien_phap": 0, "luat": 1, "bo_luat": 1, "sac_luat": 1, "phap_lenh": 2, "lenh": 2, "sac_lenh": 2, "nghi_quyet_lien_tich": 2, "nghi_dinh": 3,
    "thong_tu": 4, "thong_tu_lien_tich": 4, "thong_tu_lien_bo": 4, "quyet_dinh": 5, "chi_thi": 5, "nghi_quyet": 5,
}
UNRANKED = 99
CENTRAL_RESOLUTION_RANK = 1

# The traits that make a category apply; None: it always does.
TRIGGERS = {
    "tax": None, "labor_insurance": None, "contracts_signing": None, "residence_civil": None,
    "business_licensing": ["small_business_owner"], "property_vehicles": ["property_owner", "vehicle_owner"],
    "family_civil": ["marital_married", "has_dependents"],
}

# What is asked for each category.
QUERY_TEMPLATES = {
    "tax": "nghĩa vụ thuế của cá nhân và doanh nghiệp, thời hạn kê khai và nộp thuế",
    "labor_insurance": "nghĩa vụ của người lao động và người sử dụng lao động về lao động, bảo hiểm xã hội và bảo hiểm y tế",
    "contracts_signing": "nghĩa vụ ký kết hợp đồng, công chứng và đăng ký giao dịch",
    "residence_civil": "nghĩa vụ đăng ký cư trú, hộ tịch và tình trạng dân sự",
    "business_licensing": "nghĩa vụ đăng ký doanh nghiệp, giấy phép kinh doanh và các điều kiện hoạt động",
    "property_vehicles": "nghĩa vụ đăng ký tài sản, nhà đất và phương tiện giao thông",
    "family_civil": "nghĩa vụ gia đình và dân sự như kết hôn, nuôi con và thừa kế",
}

# Relations between documents.
SUPERSEDING = ["amend", "replace", "sua_doi", "thay_the"]
REPEALING = ["repeal", "bai_bo", "huy_bo"]
HOP_DECAY, POINTER_CONFIDENCE, MAX_HOPS = 0.75, 0.95, 5

# Shares of the coverage score.
WEIGHTS = {"jurisdiction_match": 0.30, "lexical_score": 0.20, "embedding_score": 0.20, "legal_area_boost": 0.05, "hierarchy_confidence": 0.10, "consolidation_confidence": 0.15}
TRUSTED_COVERAGE = 0.6

RRF_K, TOP_N, POOL = 60, 5, 100
BM25_K1, BM25_B, BM25_FLOOR = 1.5, 0.75, 0.25
MAX_CHARS, EXCERPT_CHARS, LOOKBACK = 1500, 600, 40

# The messages that users get.
NO_PENDING = "No pending checklist items."
NO_PENDING_WITHIN = "No pending checklist items due within {} days."
NONE_MATCHES = "No checklist item found matching '%s'."
MANY_MATCH = "Multiple items match '%s': %s. Please be more specific."
MARKED = "Marked '%s' as done."
NOTHING_FOUND = "No relevant legal information found in the knowledge base."
