"""Schemas of the business tables and of the records that flow between operators."""

from __future__ import annotations

#: Input tables, as DDL for spark.read.schema(). Dates stay strings.
BUSINESS = {
    "company": "id string, name string, industry string, founded_year long",
    "departments": "id string, name string, company_id string",
    "regions": "id string, name string",
    "products": "id string, name string, category string, price double",
    "employees": "id string, name string, email string, job_title string, department_id string, manager_id string, hire_date string",
    "customers": "id string, name string, company_name string, region_id string, email string, customer_since string",
    "orders": "id string, customer_id string, employee_id string, order_date string, status string, total_amount double",
    "order_items": "id string, order_id string, product_id string, quantity long, unit_price double, line_total double",
    "documents": "filename string, doc_type string, has_table boolean, is_scanned boolean, mentioned_employee_ids string, mentioned_customer_ids string, mentioned_product_ids string, mentioned_order_ids string, mentioned_department_ids string",
}
QUESTIONS = "id long, category string, question string, ground_truth string, source string"
ELEMENT = "pos long, type string, text string, page_number long, bbox array<double>"
#: With seq as one long where row keys are whole numbers.
TRIPLE = "subject string, relationship string, object string, subject_type string, object_type string, source string, page_number long, bbox array<double>, section string, seq struct<section:int,row:string,rule:int>"
#: The language model's triple output and the richer one with descriptions.
TRIPLES_JSON = "struct<triples:array<struct<subject:string,relationship:string,object:string,subject_type:string,object_type:string>>>"
RICH_JSON = "struct<entities:array<struct<entity_name:string,entity_type:string,entity_description:string>>,relationships:array<struct<source_entity:string,target_entity:string,relation:string,relationship_description:string>>>"
