"""Explicit schemas of the stored artifacts; nothing is inferred."""

USAGE = ("struct<prompt_tokens:bigint,completion_tokens:bigint,input_tokens:bigint,"
         "output_tokens:bigint,total_tokens:bigint>")

CONFIG = ("arm string, ticker string, as_of string, writer_requested_model string, jev_requested_model string, "
          "thresholds map<string,double>, pack_hashes map<string,string>, source_manifest map<string,string>, "
          "returned_models struct<writer:array<string>,jev:array<string>>, manual_edits_to_brief boolean")

CLAIM = "struct<text:string,kind:string,cites:array<string>>"
SECTION_CLAIMS = (f"struct<snapshot:array<{CLAIM}>,bull:array<{CLAIM}>,bear:array<{CLAIM}>,"
                  f"open_questions:array<{CLAIM}>>")
CONFLICT = "struct<higher_tier_source:string,cited_sources:array<string>,confidence:double>"
VERIFICATION = ("struct<errors:array<string>,kind:string,kind_confirmed:boolean,unavailable:boolean,"
                f"conflicts:array<{CONFLICT}>>")
RESULT = (f"struct<section:string,index:bigint,claim:{CLAIM},code_errors:array<string>,verification:{VERIFICATION},"
          f"errors:array<string>,accepted:boolean,final_claim:{CLAIM}>")
FAILURE = f"struct<section:string,index:bigint,claim:{CLAIM},errors:array<string>>"
PASS = (f"struct<stage:string,results:array<{RESULT}>,failures:array<{FAILURE}>,"
        "repair_requests:array<struct<section:string,index:bigint>>>")
RATIO = "struct<k:bigint,n:bigint,low:double,high:double>"
CHECKS = (f"status string, word_count bigint, arm string, profile struct<ticker:string,name:string,business:string>, "
          f"metrics struct<cited_ids_valid:{RATIO},numbers_matched:{RATIO},accepted_claims:bigint,"
          f"dropped_claims:bigint,system_open_questions:bigint>, accepted {SECTION_CLAIMS}, "
          f"dropped array<{FAILURE}>, structure_failures array<{FAILURE}>, passes array<{PASS}>, "
          "routes map<string,struct<status:string,reason:string>>, unavailable boolean, warnings array<string>, "
          "removals map<string,array<struct<kind:string,count:bigint>>>, error string, error_type string, "
          "repair_error string")
TIMINGS = (f"elapsed_s double, writer_attempts bigint, jev_attempts bigint, "
           f"usage array<struct<provider:string,usage:{USAGE}>>")
LABELS = ("run string, reviewer string, reviewer_type string, "
          "supported_sample array<struct<id:string,text:string,pass:boolean,note:string>>, "
          "traps map<string,struct<pass:boolean,note:string>>, rounding_false_alarms struct<count:bigint>")
ATTEMPTS = ("array<struct<attempt:bigint,status:string,error_type:string,http_status:bigint,"
            "provider_error_code:string,retry_reason:string,retry_delay_s:double,provider_requested_wait_s:double,"
            "elapsed_s:double,requested_model:string,model:string,request_sha256:string>>")
DRAFT = SECTION_CLAIMS

FILES = "path string, modificationTime timestamp, length bigint, content binary"
