"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

PROCESS_ENTRY = (
    "llmInfo struct<tokenUsage:string,result:string,prompt:string,model:string>, process string, time string, "
    "method string, fileName string, function string, errMsag string"
)
DIAG_REPORT = (
    "initialDiagnostics bigint, finalDiagnostics bigint, totalRounds int, fixSuccess boolean, "
    "roundHistory array<struct<round:int,diagnosticsFixed:bigint,remainingDiagnostics:bigint,diagnosticMessages:array<string>>>"
)
TASK = "symbolName string, sourceCode string, importString string, lineNum int, relativeDocumentPath string"
MAP_ENTRY = "struct<project_name:string,file_name:string,symbol_name:string>"
GO_EVENT = "Time string, Action string, Package string, Test string, Output string, Elapsed double"
ACTION = (
    "timestamp string, level int, action string, message string, data string, sessionId string, taskName string, "
    "durationMs bigint, metadata map<string,string>"
)
