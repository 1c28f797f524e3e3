"""Schemas of the tables the operators read, as DDL text.

Pass them to readers, so no file is opened to infer one.
"""

from __future__ import annotations

ANALYSIS_DDL = (
    "struct<score:double,summary:string,key_findings:array<struct<category:string,text:string>>,"
    "data_collected:array<string>,third_party_sharing:array<string>,user_rights:array<string>,"
    "secure_usage_recommendations:array<struct<priority:string,recommendation:string>>,"
    "contact_info:string,last_updated:string,word_count:int,reading_level:string,"
    "clauses_found:array<string>>"
)
CHANGE_DDL = (
    "array<struct<type:string,severity:string,category:string,title:string,description:string,"
    "old_text:string,new_text:string,user_impact:string>>"
)
BREACH_DDL = (
    "array<struct<Name:string,Title:string,Domain:string,BreachDate:string,AddedDate:string,"
    "ModifiedDate:string,PwnCount:bigint,Description:string,LogoPath:string,"
    "DataClasses:array<string>,IsVerified:boolean,IsFabricated:boolean,IsSensitive:boolean,"
    "IsRetired:boolean,IsSpamList:boolean>>"
)

POLICY_VERSIONS = (
    "id string, domain string, policy_type string, policy_url string, content_hash string, "
    f"raw_text string, analysis_data {ANALYSIS_DDL}, score int, word_count int, "
    "analyzed_at timestamp"
)
TRACKED_POLICIES = (
    "id string, user_id string, domain string, policy_url string, policy_hash string, "
    f"last_checked timestamp, last_analysis {ANALYSIS_DDL}, has_changes boolean, "
    f"previous_analysis {ANALYSIS_DDL}, created_at timestamp"
)
POLICY_CHANGELOGS = (
    "domain string, policy_type string, old_version_id string, new_version_id string, "
    "old_score int, new_score int, score_change int, changelog_summary string, "
    f"changelog_items {CHANGE_DDL}, overall_severity string, additions_count int, "
    "removals_count int, modifications_count int, detected_at timestamp"
)
USER_ANALYZED_SERVICES = (
    "user_id string, domain string, latest_score int, latest_version_id string, "
    "is_favorite boolean, first_analyzed_at timestamp, last_analyzed_at timestamp, "
    "analysis_count int"
)
USER_PROFILES = (
    "user_id string, region string, goals array<string>, hibp_checked_at timestamp, "
    f"hibp_breach_count int, hibp_breaches {BREACH_DDL}, personal_risk_score int, "
    "last_risk_calculation timestamp"
)
COMMUNITY_SCORES = "user_id string, domain string, score int"
ANALYSES = (
    "id string, user_id string, company_name string, domain string, policy_url string, score int, "
    "summary string, key_findings array<string>, data_collected array<string>, "
    "third_party_sharing array<string>, user_rights array<string>, raw_text string, "
    "discovery_method string, created_at timestamp"
)
PROFILES = (
    "id string, email string, display_name string, is_pro boolean, created_at timestamp"
)
USER_POLICY_HISTORY = "user_id string, policy_version_id string, viewed_at timestamp"
ANALYSIS_LOG = (
    "id string, domain string, url string, timestamp timestamp, success boolean, error string, "
    "score int, policyType string, analysisTimeMs bigint, feedbackType string, "
    "feedbackUrl string, feedbackAt timestamp"
)
DEEP_LOGS = (
    "id string, session_id string, user_id string, timestamp timestamp, phase string, "
    "message string, data string, created_at timestamp"
)
DEEP_LOG_ENTRIES = (
    "id string, timestamp timestamp, sessionId string, category string, subcategory string, "
    "level string, message string, data map<string,string>, duration bigint, "
    "metadata struct<domain:string,url:string,userId:string>"
)
EVENT_FILES = (
    "query string, url string, error string, reason string, textLength int, textPreview string, "
    "contentLength int, promptLength int, sourceUrl string, candidates array<string>, "
    "results array<struct<title:string,url:string,snippet:string>>, "
    "gemini struct<isPolicy:boolean,date:string>, grok struct<isPolicy:boolean,date:string>"
)
SCRAPING_QUEUE = (
    "id string, domain string, status string, result string, created_at timestamp, "
    "updated_at timestamp"
)
MODEL_WEIGHTS = "id string, weights string, updated_at timestamp, generation int"
LINK_EXAMPLES = (
    "features array<double>, target int, domain string, url string, model_version string, "
    "created_at timestamp"
)
CANDIDATES = (
    "domain string, url string, source string, confidence int, found_at timestamp, "
    "method_detail string"
)
TYPED_CANDIDATES = (
    "domain string, url string, type string, confidence double, source string, "
    "neural_score double, link_text string, context string"
)
SEARCH_VOTES = (
    "company string, engine string, domain string, url string, confidence int, "
    "response_time int, error string"
)
CORPUS = "filename string, content string"
KEYWORD_LABELS = (
    "term string, is_policy_related boolean, confidence string, reasoning string"
)
PAGES = "page_id bigint, url string, html string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
