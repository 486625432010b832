"""Declared schemas: no inference at read time."""

RAW_DOCUMENT_DDL = (
    "metadata struct<celex_number:string,title:string,identifier:string,eli_uri:string,html_url:string,"
    "pdf_url:string,dates:struct<`Date of document`:string,`Date of effect`:string,"
    "`Date of end of validity`:string>,authors:array<string>,responsible_body:string,form:string,"
    "eurovoc_descriptors:array<string>,subject_matters:array<string>,directory_codes:array<string>,"
    "directory_descriptions:array<string>>, content string"
)

CORPUS_DDL = {
    "documents": "document_id long, celex_number string, title string, identifier string, eli_uri string, "
    "html_url string, pdf_url string, responsible_body_id long, form_id long, date_of_document date, "
    "date_of_effect date, date_of_end_validity date, content string, html_content string, total_words int, "
    "summary string, summary_word_count int, compression_ratio double, tier int",
    "document_sections": "section_id long, document_id long, title string, content string, section_type string, "
    "section_order int, word_count int, summary string, summary_word_count int, compression_ratio double, tier int",
    "document_keywords": "id long, document_id long, keyword string, score double",
    "forms": "form_id long, form_name string",
    "responsible_bodies": "body_id long, body_name string",
    "authors": "author_id long, name string",
    "document_authors": "document_id long, author_id long",
    "eurovoc_descriptors": "descriptor_id long, descriptor_name string",
    "document_eurovoc_descriptors": "document_id long, descriptor_id long",
    "subject_matters": "subject_id long, subject_name string",
    "document_subject_matters": "document_id long, subject_id long",
    "directory_codes": "directory_id long, directory_code string, directory_label string",
    "document_directory_codes": "document_id long, directory_id long",
}

FEEDBACK_DDL = (
    "user_id string, document_id string, query string, rating int, feedback_type string, timestamp string, "
    "additional_data string"
)

PREFERENCES = "map<string,map<string,double>>"
COMPONENTS = (
    f"expert_profile:struct<description:string>,historical_documents:array<string>,"
    f"categorical_preferences:{PREFERENCES},weights:map<string,double>"
)
PROFILE_DDL = (
    f"user_id string, id string, expert_description string, profile struct<{COMPONENTS}>, "
    f"client struct<id:string,profile_components:struct<{COMPONENTS}>>"
)

SWEEP_DDL = (
    "best_weights map<string,double>, best_score double, metric string, "
    "all_results array<struct<weights:map<string,double>,score:double,metrics:map<string,double>>>"
)
