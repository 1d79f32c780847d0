"""Schemas of the findings model. A key that a report leaves out is NULL."""

from __future__ import annotations

STEP = "struct<file:string,line:int,message:string,label:string>"
EVIDENCE = f"struct<source:string,sink:string,dataflow:array<{STEP}>>"
TRIAGE = "struct<status:string,rationale:string,confidence:double,validated_at:string>"

FINDING = f"""
id string, tool string, tools array<string>, rule_id string, rule_ids array<string>, title string, message string,
severity string, confidence string, language string, file string, start_line int, end_line int, cwe array<string>,
owasp array<string>, evidence {EVIDENCE}, recommendation string, fingerprint string, fingerprint_v1 string,
snippet_hash string, is_new boolean, is_suppressed boolean, suppression_reason string, triage {TRIAGE},
analysis_enrichment struct<origin:string,evidence_strength:string,triage_status:string>, llm_analysis_notes string,
context string, original_severity string, confidence_score double
"""

_LOCATION = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int,snippet:struct<text:string>>>>"
_STEP = "struct<location:struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,snippet:struct<text:string>>>,message:struct<text:string>>>"
_RULE = (
    "struct<id:string,shortDescription:struct<text:string>,help:struct<text:string>,defaultConfiguration:struct<level:string>,"
    "properties:struct<tags:array<string>,precision:string,issue_severity:string,issue_confidence:string,`security-severity`:string>>"
)
SARIF = (
    f"`$schema` string, version string, runs array<struct<tool:struct<driver:struct<name:string,version:string,rules:array<{_RULE}>>>,"
    f"results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,locations:array<{_LOCATION}>,"
    f"codeFlows:array<struct<threadFlows:array<struct<locations:array<{_STEP}>>>>>>>>>"
)

ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,line:int,message:string>>>>"
PHPSTAN = "struct<files:map<string,struct<errors:int,messages:array<struct<message:string,line:int,ignorable:boolean,identifier:string>>>>>"
SEMGREP = "struct<results:array<struct<path:string,check_id:string,extra:struct<metadata:struct<cwe:string>>>>>"
_LLM = f"struct<id:string,rule_id:string,title:string,message:string,severity:string,file:string,start_line:int,cwe:array<string>,evidence:{EVIDENCE},triage:{TRIAGE},llm_analysis_notes:string>"
ENVELOPE = (
    f"struct<schema_version:string,session_id:string,findings:array<{_LLM}>,dismissed_targets:array<struct<target_id:string,reason:string>>,"
    f"confirmed_findings:array<struct<target_id:string,finding:{_LLM}>>,llm_analysis_complete:boolean,agent_review_complete:boolean>"
)
LLM_LIST = f"array<{_LLM}>"

BASELINE = "fingerprint string, first_seen timestamp"
SUPPRESSION = "fingerprint string, reason string, owner string, expires_at date, seq bigint"
AUDIT = "seq bigint, action string, fingerprint string"
HISTORY = "scan_id string, timestamp string, total_findings int, severity_counts map<string,int>, fingerprints array<string>"
GROUND_TRUTH = "name string, category string, real string, cwe string"
